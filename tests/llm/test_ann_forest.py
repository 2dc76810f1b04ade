"""Nearest neighbours against brute force: recall, exact scores and order, odd vectors."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from spendlens.llm import ann_forest, queries


def brute_force(rows, asks, k):
    """query -> [(vec_id, score)], nearest first; rows of finite vectors, equal ids counted by their best."""
    width = max(len(v) for _, v in rows)
    ids = np.array([i for i, _ in rows])
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in rows], float)
    out = {}
    for q in sorted({i for i in ids.tolist() if asks(i)}):
        own = min(v for i, v in rows if i == q)
        scores, best = x @ np.array([*own, *[0.0] * (width - len(own))], float), defaultdict(lambda: -np.inf)
        for i, s in zip(ids.tolist(), scores.tolist()):
            if i != q:
                best[i] = max(best[i], s)
        out[q] = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def recall(got, want):
    """Share of the neighbours found; a score as good as the last one's counts."""
    hits = [sum(s >= want[q][-1][1] - 1e-12 for _, s in got.get(q, [])) / len(want[q]) for q in want if want[q]]
    return float(np.mean(hits))


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).collect()]
    got, want = found(queries.op11_rp_forest_search(spark, folder)), brute_force(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    vectors = {i: np.array(v) for i, v in rows}
    for q in list(got)[:50]:
        assert got[q] == sorted(got[q], key=lambda b: (-b[1], b[0])) and q not in dict(got[q])
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for i, s in got[q])
    assert recall(got, want) >= 0.93


def test_vectors_of_any_length_and_copies(spark):
    """Norms far apart, a vector with a third of all rows, ties, repeated ids and rows that take no part."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 12)) * 3
    rows = [(i, (centres[i % 8] + rng.normal(size=12) * 0.1).tolist()) for i in range(1200)]
    rows += [(2000 + i, [1.0] * 12) for i in range(600)]
    rows += [(3000 + i, (rng.normal(size=12) * 10 ** rng.uniform(-3, 1)).tolist()) for i in range(200)]
    rows += [(4000, [1.0, 2.0]), (20, [5.0] * 12), rows[3], (-20, [0.0, -1.0] * 6), (1, [-0.0, 1.0] * 6), (5, [0.0, 1.0] * 6)]
    odd = [(5000, None), (5020, [0.0] * 12), (5040, [float("nan")] * 12), (5060, [float("inf")] + [0.0] * 11), (5080, [None, 1.0]), (5100, []), (None, [1.0] * 12)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as query", "embedding as x", "vec_id as leaf")
    got = found(ann_forest.nearest(frame, F.col("vec_id") % 20 == 0, k=7, leaf=32))
    want = brute_force(rows, lambda i: i % 20 == 0, 7)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    everything = found(ann_forest.nearest(frame, F.col("vec_id") % 20 == 0, k=7, leaf=32, recall=1.1))  # every leaf
    assert {q: [i for i, _ in v] for q, v in everything.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_blocks_of_leaves_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann_forest, "BLOCK", 10)
    got = found(ann_forest.nearest(frame, F.col("vec_id") % 3 == 0, k=5, sample=200, recall=1.1))
    want = brute_force(rows, lambda i: i % 3 == 0, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_few_rows_and_huge_components(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = F.col("vec_id") % 20 == 0
    assert found(ann_forest.nearest(frame([(0, [1.0])]).where("false"), asks)) == {}
    assert found(ann_forest.nearest(frame([(0, [1.0])]), asks)) == {}
    assert found(ann_forest.nearest(frame([(0, [1.0]), (1, [2.0]), (20, [-1.0])]), asks)) == {0: [(1, 2.0), (20, -1.0)], 20: [(0, -1.0), (1, -2.0)]}
    got = found(ann_forest.nearest(frame([(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [1e-200, 1.0]), (3, [-1e200, 0.0])]), asks))
    assert got == {0: [(1, np.inf), (2, 2.0), (3, -np.inf)]}
