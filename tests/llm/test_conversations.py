"""Conversation repair against a plain dynamic programme over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F
from spendlens.llm import conversations, queries

BLANKS = " \t\n\x0b\x0c\r"


def brute_force(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.rstrip(BLANKS)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # the roles' initials so far matter by their last one

    def add(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def fits(state, r):
        return (state, r) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    def inserted(table):
        for _ in range(3):
            for state, (c, a, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if fits(state, role[0]):
                        add(table, role[0], (c + 2, a + "I", (*out, f"{role}:")))
        return table

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (c, a, out) in inserted(best).items():
            add(after, state, (c + 3, a + "D", out))
            if fault in ("", "truncated"):
                c += fault == "truncated"
                if fits(state, role[:1]):
                    add(after, role[:1], (c, a + "K", (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if fits(state, new[0]):
                        add(after, new[0], (c + 2, a + "R", (*out, f"{new}:{text}")))
        best = after
    cost, audit, out = min(way for state, way in inserted(best).items() if state in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum((x[1][:1] or " ") + (y[1][:1] or " ") not in ("su", "ua", "au") for x, y in zip(rows, rows[1:])),
            cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    groups = defaultdict(list)
    for key, turn, role, text in rows:
        groups[key].append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {k: brute_force(sorted(v, key=order)) for k, v in groups.items()}


def hurt(rows):
    """Rows after the damage of the registered query, and all conversations."""
    out = []
    for key, turn, role, text in rows:
        shown = [" " if x is None else x for x in (key, turn, role, text)]
        which = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = "user" if which == 4 else shown[2], "" if which == 1 else re.sub("[.!?]", "", shown[3]) if which == 2 else shown[3]
        out += [(key, turn, role, text)] * {0: 0, 3: 2}.get(which, 1)
    return out


def found(done):
    digests = {r[0]: r[1] for r in done.digests.collect()}
    rows = done.report.collect()
    assert len(rows) == len(digests)
    return {r[0]: (*r[1:], digests[r[0]]) for r in rows}


def random_rows(seed, conversations_, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "", " \t", "Why? \n", " ", "a. ", "漢。", "ok.\x85"]
    rows = []
    for c in range(conversations_):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 1, t // 2, None])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice([*texts, None, f"{t} words.", f"{t} words!", f"more of {t}."])))
    return rows + rows[::7]


SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id as key", "turn as part", "text as edits", "role as n")


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4])
def test_search_of_every_short_conversation(length):
    kinds = [("s", False, 0, 0), ("u", False, 0, 0), ("a", False, 1, 0), ("u", True, 0, 0), ("t", False, 0, 0)]
    words = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    for rows in product(kinds, repeat=length):
        plain = [(i, words[r], "" if gone else f"text {i}" + ("" if cut else ".")) for i, (r, gone, cut, _) in enumerate(rows)]
        assert conversations.cheapest(rows, conversations.START, conversations.WHOLE) == brute_force(plain)[5:7]


def test_search_is_quick_on_long_conversations():
    rng = random.Random(3)
    for weights in ([1, 1, 1, 1], [8, 8, 1, 1], [1, 9, 1, 0], [0, 1, 9, 0]):
        kinds = [(r, rng.random() < 0.1, 0, 0) for r in rng.choices("suat", weights, k=conversations.SEGMENT)]
        rows = tuple((r, gone, int(not gone and rng.random() < 0.3), 0) for r, gone, _, _ in kinds)
        assert conversations.cheapest(rows, conversations.START, conversations.WHOLE) is not None


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 5])
def test_repair(spark, segment):
    rows = random_rows(segment, 60, 14) + random_rows(9, 3, 120) + [(None, 1, "user", "Hi."), (None, None, "assistant", None), (77, None, None, None)]
    got = found(conversations.repair(frame(spark, rows), segment=segment))
    assert got == expected(rows)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", "", f"{t}.", f"{t}"])) for t in range(900)]
    rows += [(2, 0, "user", "again.")] * 400 + [(3, t, "user", " ") for t in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")  # more than one level of pieces
    try:
        done = conversations.repair(frame(spark, rows), segment=16)
        assert found(done) == expected(rows)
        turns = done.turns.where("conv_id = 1").orderBy("part", "seq").collect()
        assert "".join(t.edit for t in turns) == expected(rows)[1][6]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_damage_and_repair_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += random_rows(1, 40, 9) + [(5000 + i, 0, "user", "Hello.") for i in range(60)]
    want = {k: brute_force([]) for k in {r[0] for r in rows}} | expected(hurt(rows))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in conversations.damaged_and_repaired(frame(spark, rows)).collect()}
    assert got == want and any(w[6] == "" for w in want.values())


def test_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "user", "y" * 3_000_000), (2, 0, "assistant", "Hi.")]
    assert found(conversations.repair(frame(spark, rows), segment_bytes=1 << 20)) == expected(rows)
    assert found(conversations.repair(frame(spark, rows).where("false"))) == {}
    assert conversations.damaged_and_repaired(frame(spark, rows).where("false")).count() == 0


def test_query(spark, sf):
    assert queries.op13_conversation_repair(spark, sf).count() == spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id")).distinct().count()
