"""Lexical search against brute force over all documents, and against its SQL."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from spendlens.llm import lexical

LOWER = {u: u + 32 for u in range(65, 91)}


def words(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def brute_force(docs, items, k):
    counted = [(key, Counter(words(text))) for key, text in docs if key is not None]
    counted = [(key, c) for key, c in counted if c]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        if item is not None:
            wanted[item].update(words(text))
    out = {}
    for item, terms in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        scored = []
        for key, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // n_words
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                scored.append((-score, key))
        if scored:
            out[item] = [(key, -score) for score, key in sorted(scored)[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("item", "rank").collect():
        out[r["item"]].append((r["doc"], r["score"]))
        assert r["rank"] == len(out[r["item"]])
    return dict(out)


def made(seed, n):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(300)] + ["Été", "漢字", "ﬁ", "\x85", "I"]
    weights = [Fraction(1, i + 1) for i in range(len(names))]
    text = lambda most: rng.choice([" ", ", ", "\n", "."]).join(rng.choices(names, weights, k=rng.randint(0, most)))
    docs = [(rng.randrange(10 * n), text(rng.choice([5, 40, 400]))) for _ in range(n)]
    docs += docs[::9] + [(None, "w1 w2"), (7, None), (8, ""), (9, " .,"), (10, "W1 " * 30000), (11, "w299")] + [(100 + i, "w1 w200") for i in range(60)]
    items = [(i, text(30)) for i in range(25)] + [(30, "w1 W1"), (31, None), (32, ""), (33, "absent"), (None, "w1"), (34, "w299"), (34, "w0"), (35, "W200 w1")]
    return docs, items


@pytest.mark.parametrize("shard_bytes,window", [(2000, 8), (20000, 64), (lexical.SHARD_BYTES, lexical.WINDOW)])
def test_search(spark, monkeypatch, shard_bytes, window):
    docs, items = made(window, 700)
    docs_frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as key", "text as term", "doc_id as shard")
    items_frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as term", "item_id as item")
    index = lexical.build_index(docs_frame.repartition(3), shard_bytes=shard_bytes)
    got = found(lexical.search(index, items_frame, k=7, window=window, pass_terms=100))
    assert got == brute_force(docs, items, 7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(lexical.search(lexical.build_index(docs), items)) == brute_force([(1, "a b")], [(1, "a")], 50)
    assert found(lexical.search(lexical.build_index(docs.where("false")), items)) == {}
    assert found(lexical.search(lexical.build_index(docs), items.where("false"))) == {}


def test_numbers_in_bytes():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40], np.int64)
    raw, _ = lexical.packed(values)
    assert lexical.unpacked(raw).tolist() == values.tolist()


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 5)
    text = "One two, three-four  \x85five " + "x" * 40 + " É"
    assert [t.decode() for part in lexical.terms_of(text.encode()) for t in part] == words(text)


def test_blocks_are_rejected_before_they_are_read(monkeypatch):
    """One long list of small scores beside a short list of high ones: few of the long list's blocks are read."""
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n, rng = 20_000, np.random.default_rng(2)
    term = [np.append(np.zeros(rng.integers(1, 4), np.int32), np.full(9, 2, np.int32)) for _ in range(n)]
    for i in range(0, n, 400):
        term[i] = np.append(term[i], np.ones(3, np.int32))
    lengths = np.array([len(t) for t in term])
    schema = to_arrow_schema(StructType.fromDDL(lexical.INDEX))
    rows = lexical.shard_rows(0, np.arange(n), lengths.astype(np.int32), [b"often", b"seldom", b"other"], np.concatenate(term), np.repeat(np.arange(n), lengths), schema)
    pdf = pa.Table.from_batches(list(rows)).to_pandas()
    norms = lambda m: 50 + 50 * m.astype(np.int64) * n // int(lengths.sum())
    lists = [lexical.Postings(r, {"often": 3, "seldom": 5000}[r.term], norms) for r in pdf[pdf.term.isin(["often", "seldom"])].itertuples()]
    docs, scores = lexical.best_of_shard(lists, lengths.astype(np.int32), 10, 1024)
    often = max(lists, key=lambda p: p.df)
    assert len(docs) == 10 and often.read.sum() < len(often.read) / 2
    everything = sum(np.bincount(p.docs, p.parts, n) for p in lists for _ in [p.decompress(np.arange(len(p.last)), lengths)])
    assert scores.tolist() == sorted(everything.astype(int).tolist(), reverse=True)[:10]
    assert isinstance(pdf, pd.DataFrame)
