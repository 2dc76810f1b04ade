"""Conversation structure repair: the cheapest edits that give every conversation the turns system? (user assistant)*.

Edits of a row: keep it (K, free), give it the role user or assistant (R, 2), delete it (D, 3; the only
edit of a blank or repeated row), or insert an empty user or assistant turn before it (I, 2). A truncated
row that stays costs 1 more. Of equally cheap repairs the one with the ASCII-least audit (the initials of
its edits in order) is taken.

The search is a depth-first branch and bound with a stack of its own. Suffix lower bounds (the least that the
rows from a node on can cost, audits left aside) cut prefixes that can't reach the incumbent (cost,
audit), and a table for each node (row, state) cuts prefixes that a better one has reached; when the stack
is empty the incumbent is proved. Weaker bounds (forced deletions and counts of adjacent roles that can't
stand) made the search of 256 rows take minutes; with these each node is opened about once.

Rows are range-partitioned by conversation and turn, so a conversation with a third of all rows lies in
many partitions. One that lies inside a partition and has up to ``SEGMENT`` runs of equal rows is repaired
there. Of the others each partition holds a piece, whose cheapest repair between any two states is found
by the same search, segment by segment; pieces of a conversation are then put together in groups of
``FAN``, level by level. Equal prefixes of equal cost can't be proper prefixes of each other (the longer one has
paid for its insertions), so the least (cost, audit) of the parts makes that of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .chunks import text_slices
from .common import stored

#: Runs of equal rows that one search takes, and that a task holds at a time.
SEGMENT = 256
#: Pieces put together at a time.
FAN = 64

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What a row that stays as it is makes of a state; other pairs can't stand.
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The turn that an inserted or renamed row is, from a state.
FILLS = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
LAST = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
WHOLE = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: White space of the text rules.
SPACE = r" \t\n\u000B\f\r"


@lru_cache(100_000)
def cheapest(rows: tuple, start: int, ends: tuple) -> tuple[int, str] | None:
    """Least (cost, audit) that takes ``rows`` from state ``start`` to one of ``ends``; None if nothing does.

    Each row is (initial of its role, whether it must go, whether it is truncated, copies behind it that must go).
    """
    m = len(rows)
    never = 3 * m + sum(3 * r[3] for r in rows) + 99
    # bounds[i][state]: the suffix from row i can't be repaired for less, whatever the audit
    bounds = [[0 if state in ends else never for state in STATES]]
    for row in (None, *reversed(rows)):
        if row is not None:
            initial, gone, cut, copies = row
            after = bounds[-1]
            least = [3 + after[state] for state in STATES]
            if not gone:
                least = [min(least[state], 2 + cut + after[FILLS[state]], cut + after[KEEPS[state, initial]] if (state, initial) in KEEPS else never)
                         for state in STATES]
            bounds.append([3 * copies + x for x in least])
        for _ in STATES:
            bounds[-1] = [min(least, 2 + bounds[-1][FILLS[state]]) for state, least in enumerate(bounds[-1])]
    bounds.reverse()

    best, audit_of_best = None, ""
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(bounds[0][start], 0, start, 0, "")]
    while stack:
        least, i, state, cost, audit = stack.pop()
        if least >= never or best is not None and (least > best or least == best and audit > audit_of_best[:len(audit)]):
            continue
        before = reached.get((i, state))
        if before is not None and before <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == m and state in ends and (best is None or (cost, audit) < (best, audit_of_best)):
            best, audit_of_best = cost, audit
        nodes = [(i, FILLS[state], cost + 2, audit + "I")]
        if i < m:
            initial, gone, cut, copies = rows[i]
            rest, paid = "D" * copies, cost + 3 * copies
            nodes.append((i + 1, state, paid + 3, audit + "D" + rest))
            if not gone:
                kept = KEEPS.get((state, initial))
                if kept is not None:
                    nodes.append((i + 1, kept, paid + cut, audit + "K" + rest))
                nodes.append((i + 1, FILLS[state], paid + 2 + cut, audit + "R" + rest))
        stack.extend(sorted(((c + bounds[j][to], j, to, c, a) for j, to, c, a in nodes), key=lambda x: (x[0], x[4]), reverse=True))
    return None if best is None else (best, audit_of_best)


def moves(rows: tuple) -> dict:
    """The cheapest repair of ``rows`` between any two states: (from, to) -> (cost, audit, path)."""
    found = {(a, b): cheapest(rows, a, (b,)) for a in STATES for b in STATES}
    return {ab: (*best, str(ab[1])) for ab, best in found.items() if best}


def in_a_row(one: dict, two: dict, name_stop: bool) -> dict:
    """Moves through two neighbouring parts; with ``name_stop`` the path names the state between them."""
    out = {}
    for (a, mid), (c1, a1, p1) in one.items():
        for (start, b), (c2, a2, p2) in two.items():
            if start == mid:
                way = (c1 + c2, a1 + a2, p1 + p2 if name_stop else p2)
                if (a, b) not in out or way[:2] < out[a, b][:2]:
                    out[a, b] = way
    return out


NOTHING = {"rows": 0, "first": "", "last": "", "lo": None, "hi": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}


def added(one: dict, two: dict) -> dict:
    """Counts of two neighbouring parts of a conversation together."""
    both = {k: one[k] + two[k] for k in ("rows", "blank", "duplicate", "truncated")}
    meet = one["rows"] and two["rows"] and one["last"] + two["first"] not in LEGAL
    same = one["hi"] is not None and one["hi"] == two["lo"]
    return both | {"first": one["first"] if one["rows"] else two["first"], "last": two["last"] if two["rows"] else one["last"],
                   "lo": two["lo"] if one["lo"] is None else one["lo"], "hi": one["hi"] if two["hi"] is None else two["hi"],
                   "turns": one["turns"] + two["turns"] - same, "illegal": one["illegal"] + two["illegal"] + bool(meet)}


def counts(run: dict) -> dict:
    """Counts of one run of equal rows."""
    n, t = run["n"], run["turn"]
    if not n:
        return NOTHING
    again = n - 1 + run["again"]
    # a role without an initial can't follow or precede any other
    initial = run["role"][:1] or " "
    return {"rows": n, "first": initial, "last": initial, "lo": t, "hi": t, "turns": int(t is not None),
            "blank": n if run["blank"] else 0, "duplicate": 0 if run["blank"] else again,
            "truncated": int(run["cut"] and not run["blank"] and not run["again"]), "illegal": n - 1}


def searched(run: dict) -> tuple:
    """A run as the search takes it."""
    gone = bool(run["blank"] or run["again"])
    return (run["role"][:1], gone, int(run["cut"] and not gone), run["n"] - 1)


def gaps(c: dict) -> int:
    return c["hi"] - c["lo"] + 1 - c["turns"] if c["hi"] is not None else 0


def edited(runs: Iterable[dict], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every row, inserted ones too, by an audit that begins in ``state``."""
    at = 0
    for run in [*runs, None]:
        while audit[at:at + 1] == "I":
            state = FILLS[state]
            yield "I", ROLES[state], ""
            at += 1
        if run is None:
            return
        edit = audit[at]
        if edit == "K":
            state = LAST[run["role"][0]]
        elif edit == "R":
            state = FILLS[state]
        yield edit, ROLES[state] if edit == "R" else run["role"], run["text"]
        for _ in range(run["n"] - 1):
            yield "D", run["role"], run["text"]
        at += run["n"]


MOVES = "moves array<struct<a int,b int,cost long,audit string,path string>>"
COUNTS = "rows long, first string, last string, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long"
RUN = "role string, text string, n long, blank_text boolean, cut boolean, again boolean"
EDITS = "edits array<struct<edit string,role string,text string>>"


def listed(ways: dict) -> list[dict]:
    return [dict(a=a, b=b, cost=c, audit=t, path=p) for (a, b), (c, t, p) in sorted(ways.items())]


def unlisted(ways: Iterable[dict]) -> dict:
    return {(w["a"], w["b"]): (w["cost"], w["audit"], w["path"]) for w in ways}


def search_partition(batches: Iterable[pa.RecordBatch], schema: pa.Schema, segment: int, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs -> repaired conversations ('whole'), pieces of others ('piece') and the rows of these ('run')."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out, weight = [], 0
    key, opened, runs, held, piece, seq = None, False, [], 0, None, 0
    first = True  # the first conversation of a partition may have begun in the one before

    def emit(**row):
        nonlocal weight
        out.append({"key": key, "part": part} | row)
        weight += 200 + len(row.get("text") or "") + sum(len(e["text"]) for e in row.get("edits") or ())

    def ready(force=False):
        nonlocal out, weight
        if out and (force or weight > 8 << 20):
            yield pa.RecordBatch.from_pylist(out, schema)
            out, weight = [], 0

    def put_down():
        """The runs held become a segment of a piece."""
        nonlocal piece, seq, runs, held
        tally, ways = piece or (NOTHING, None)
        for run in runs:
            tally = added(tally, counts(run))
            seq += 1
            emit(kind="run", seq=seq, role=run["role"], text=run["text"], n=run["n"], blank_text=run["blank"], cut=run["cut"], again=run["again"])
        more = moves(tuple(map(searched, runs)))
        piece = tally, more if ways is None else in_a_row(ways, more, False)
        runs, held = [], 0

    def close(last):
        nonlocal piece, seq, first
        if opened:
            if first or last or piece:
                put_down()
                tally, ways = piece
                emit(kind="piece", seq=0, moves=listed(ways), **tally)
            else:
                tally = NOTHING
                for run in runs:
                    tally = added(tally, counts(run))
                cost, audit = cheapest(tuple(map(searched, runs)), START, WHOLE)
                emit(kind="whole", seq=0, gaps=gaps(tally), cost=cost, audit=audit, **tally,
                     edits=[dict(edit=e, role=r, text=t) for e, r, t in edited(runs, audit, START)])
            first = False
        piece, seq = None, 0

    for batch in batches:
        for some in text_slices(batch, "text"):
            for row in some.to_pylist():
                if not opened or row["key"] != key:
                    close(False)
                    yield from ready()
                    key, opened, runs, held = row["key"], True, [], 0
                if row["n"]:
                    runs.append({"turn": row["turn"], "role": row["role"], "text": row["text"], "n": row["n"],
                                 "blank": row["blank_text"], "cut": row["cut"], "again": row["again"]})
                    held += len(row["text"])
                    if len(runs) > segment or held > segment_bytes:
                        put_down()
                        yield from ready()
    close(True)
    yield from ready(True)


def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring pieces of one conversation as one piece."""
    tally, ways, parts = NOTHING, None, []
    for row in pdf.sort_values("part").to_dict("records"):
        own = {k: None if k in ("lo", "hi") and pd.isna(row[k]) else row[k] if k in ("first", "last") else int(row[k]) for k in NOTHING}
        tally, parts = added(tally, own), parts + list(row["parts"])
        more = unlisted(row["moves"])
        ways = more if ways is None else in_a_row(ways, more, True)
    out = pd.DataFrame([{"key": pdf["key"].iloc[0], "part": int(pdf["part"].iloc[0]), "parts": parts, "moves": listed(ways)} | tally])
    return out.astype({"lo": "Int64", "hi": "Int64"})


def edit_pieces(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a piece behind its audit (seq 0) -> the edited rows, ``seq`` numbering them."""
    audit, state, number, key, part = "", START, 0, None, None

    def rows(runs, tail):
        nonlocal audit, state, number
        used = 0
        for edit, role, text in edited(runs, audit if tail else audit[:_length(audit, runs)], state):
            used += 1
            state = {"K": LAST.get(role[:1], state), "D": state}.get(edit, USER if role == "user" else ASSISTANT)
            number += 1
            yield {"key": key, "part": part, "seq": number, "edit": edit, "role": role, "text": text}
        audit = audit[used:]

    for batch in batches:
        for some in text_slices(batch, "text"):
            out = []
            for row in some.to_pylist():
                if row["seq"] == 0:
                    out.extend(rows([], True))
                    audit, state, number, key, part = row["audit"], row["state"], 0, row["key"], row["part"]
                else:
                    out.extend(rows([row], False))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
    out = list(rows([], True))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _length(audit: str, runs: list[dict]) -> int:
    """Letters of an audit that the next runs take."""
    n = sum(run["n"] for run in runs)
    at = 0
    while n:
        n -= audit[at] != "I"
        at += 1
    return at


def digest_lines(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every conversation's kept rows, read in order; only the hash under way is held."""
    key, digest, any_row = None, None, False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if digest is None or row["key"] != key:
                if digest is not None:
                    out.append({"key": key, "repaired_sha256": digest.hexdigest()})
                key, digest, any_row = row["key"], hashlib.sha256(), False
            if row["edit"] != "D":
                digest.update((("\n" if any_row else "") + row["role"] + ":" + row["text"]).encode())
                any_row = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "repaired_sha256": digest.hexdigest()}], schema)


@dataclass
class Repaired:
    """``report``: a row for each conversation; ``turns``: a row for each edited row; ``digests``: SHA-256 of ``role:text`` lines."""
    report: DataFrame
    turns: DataFrame
    digests: DataFrame


def runs_of_equal_rows(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, n) -> runs of equal rows with their faults; n is 0 for a conversation's rows that are gone."""
    trimmed = F.expr(f"trim(trailing '{SPACE}' from text)")
    runs = stored(rows.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("n"))
                  .withColumn("sha", F.sha2(F.encode("text", "utf-8"), 256))
                  .withColumn("blank_text", trimmed == "")
                  .withColumn("cut", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")), "runs")
    repeats = runs.where("n > 0 and not blank_text").groupBy("key", "role", "sha") \
        .agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("times")).where("times > 1") \
        .select(F.col("key").alias("k"), F.col("role").alias("r"), F.col("sha").alias("s"), "earliest")
    joined = runs.join(repeats, F.col("key").eqNullSafe(F.col("k")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
    again = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn")) & ~F.col("blank_text")
    return joined.select("key", "turn", "role", "text", "n", "blank_text", "cut", again.alias("again"))


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: str | None = None, segment: int = SEGMENT, segment_bytes: int = 16 << 20) -> Repaired:
    """The cheapest repair of every conversation.

    Rows are taken by turn (nulls first), then role and text. A null role or text is one blank; a null key is a
    conversation of its own; equal rows are copies, all but the first repeated. ``copies`` names a column
    with how often a row stands (0: not at all, but its conversation is reported). A conversation without rows
    has no edits and zeros; an empty table gives empty results. Other columns are not read. A
    conversation's audit is one value, and its digest is computed over its rows in order by one task, which
    holds one batch of them.
    """
    spark = conversations.sparkSession
    q = lambda c: F.col(f"`{c}`")
    n = q(copies).cast("long") if copies else F.lit(1).cast("long")
    rows = conversations.select(q(key).alias("key"), q(turn).cast("long").alias("turn"), F.coalesce(q(role).cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(q(text).cast("string"), F.lit(" ")).alias("text"), n.alias("n"))
    here = F.col("n") > 0
    rows = rows.select("key", *[F.when(here, F.col(c)).alias(c) for c in ("turn", "role", "text")], "n")
    kind = rows.schema["key"].dataType
    ordered = runs_of_equal_rows(rows).repartitionByRange("key", "turn", "role", "text").sortWithinPartitions("key", "turn", "role", "text")

    def fields(ddl: str) -> list[StructField]:
        return [StructField("key", kind), *StructType.fromDDL(ddl).fields]

    def flow(df: DataFrame, task, ddl: str, **more) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = StructType(fields(ddl))
        return df.mapInArrow(partial(task, schema=to_arrow_schema(schema), **more), schema)

    found = stored(flow(ordered, search_partition, f"part int, kind string, seq long, role string, text string, n long, blank_text boolean, cut boolean, again boolean, "
                        f"{COUNTS}, gaps long, cost long, audit string, {MOVES}, {EDITS}", segment=segment, segment_bytes=segment_bytes), "conversations")
    whole = found.where("kind = 'whole'")
    names = [f.name for f in StructType.fromDDL(COUNTS).fields]
    own = found.where("kind = 'piece'").select("key", "part", F.array("part").alias("parts"), *names, "moves")
    schema = StructType(fields(f"part int, parts array<int>, {COUNTS}, {MOVES}"))
    pieces, widest = own, own.agg(F.max("part")).first()[0]
    while widest is not None:
        grouped = pieces.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        # the order of the parts within a group is that of their first partition
        grouped = grouped.withColumn("at", F.col("part")).withColumn("part", F.col("parts")[0])
        pieces = stored(grouped.groupBy("key", "at").applyInPandas(lambda k, pdf: put_together(pdf).assign(part=int(k[-1])), schema), "pieces")
        if widest < FAN:
            break
        widest //= FAN
    report = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    ends = F.filter("moves", lambda w: (w.a == START) & w.b.isin(*WHOLE))
    least = F.array_min(F.transform(ends, lambda w: F.struct(w.cost, w.audit, w.path)))
    done = pieces.withColumn("best", least).withColumn("gaps", F.when(F.col("hi").isNotNull(), F.col("hi") - F.col("lo") + 1 - F.col("turns")).otherwise(F.lit(0))) \
        .select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "best.path", "parts")
    # each piece's own way through it, by the states between the pieces
    stops = done.select("key", "path", F.posexplode("parts").alias("i", "part")) \
        .select("key", "part", F.when(F.col("i") == 0, F.lit(START)).otherwise(F.substring("path", F.col("i"), F.lit(1)).cast("int")).alias("a"),
                F.substring("path", F.col("i") + 1, F.lit(1)).cast("int").alias("b"))
    mine = own.select(F.col("key").alias("k"), F.col("part").alias("p"), F.explode("moves").alias("w"))
    audits = stops.join(mine, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")) & (F.col("a") == F.col("w.a")) & (F.col("b") == F.col("w.b")))
    runs = found.where("kind = 'run'").select("key", "part", "seq", "role", "text", "n", F.lit(None).cast("string").alias("audit"), F.lit(START).alias("state"))
    heads = audits.select("key", "part", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                          F.lit(0).cast("long").alias("n"), F.col("w.audit").alias("audit"), F.col("a").alias("state"))
    in_pieces = runs.unionByName(heads).repartition("key", "part").sortWithinPartitions("key", "part", "seq")
    cut_up = stored(flow(in_pieces, edit_pieces, "part int, seq long, edit string, role string, text string"), "edited")
    lines = cut_up.repartition("key").sortWithinPartitions("key", "part", "seq")
    long_digests = flow(lines, digest_lines, "repaired_sha256 string")
    line = lambda e: F.concat(e.role, F.lit(":"), e.text)
    short_digests = whole.select("key", F.sha2(F.encode(F.concat_ws("\n", F.transform(F.filter("edits", lambda e: e.edit != "D"), line)), "utf-8"), 256).alias("repaired_sha256"))
    # a conversation none of whose rows is left has no lines
    nothing = done.where("audit = ''").select("key", F.sha2(F.lit(b""), 256).alias("repaired_sha256"))
    turns = whole.select("key", "part", F.posexplode("edits").alias("seq", "e")).select("key", "part", F.col("seq").cast("long").alias("seq"), "e.*").unionByName(cut_up)
    renamed = lambda df: df.withColumnRenamed("key", key)
    return Repaired(renamed(whole.select(*report).unionByName(done.select(*report))), renamed(turns),
                    renamed(short_digests.unionByName(long_digests).unionByName(nothing)))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` (nulls: one blank) modulo 20 chooses; ``copies`` is 0 for a dropped row."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.pmod(F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "utf-8")), F.lit(20))
    return conversations.select(
        "conv_id", "turn", F.when(which == 4, F.lit("user")).otherwise(shown("role")).alias("role"),
        F.when(which == 1, F.lit("")).when(which == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text")).alias("text"),
        F.when(which == 0, 0).when(which == 3, 2).otherwise(1).alias("copies"))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """One row for every conversation: its faults after :func:`damaged`, the cost and audit of its repair and the digest of what it gives."""
    done = repair(damaged(conversations), copies="copies")
    digests = done.digests.withColumnRenamed("conv_id", "k")
    return done.report.join(digests, F.col("conv_id").eqNullSafe(F.col("k"))).drop("k")
