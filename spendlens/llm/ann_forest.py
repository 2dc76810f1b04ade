"""Nearest neighbours by inner product: a forest of random-projection trees searched through one priority queue.

The largest inner product is the largest cosine once every vector gets one more component that makes
its norm the greatest of all (queries get a zero there). Trees are fitted on a bounded sample: each node parts its
rows at the median of a random projection. Every row is then put in its leaf of each tree.

A query searches all trees through one queue of nodes, ordered by the chance that a neighbour lies
below them: given the score it has to reach (estimated from the sample), the projection of a neighbour is about
normal, with mean and spread from the sample's mean and covariance. Leaves are taken until the chance that a
neighbour has been missed in every tree falls to a limit, so the effort follows the data: near-copies need a leaf or
two, vectors without any structure a large part of the forest. The limit is measured: sampled rows search for their
known neighbours in the sample, and it is set where ``recall`` of these are met. All rows of the leaves are scored exactly.

Equal vectors are one class with its smallest ids, and equal queries one search. Leaves and the queries that visit
them are cut into blocks of bounded size, each pair of blocks a task's group.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TREES = 4
#: Rows of a leaf that the trees aim at.
LEAF = 256
#: Sampled rows in a leaf at least: with more rows than the sample can part, leaves grow and are cut into blocks.
SAMPLED_LEAF = 16
#: The index is fitted on this many rows at most, and on this many bytes of vectors (what the driver and each task hold).
SAMPLE, SAMPLE_BYTES = 32_768, 16 << 20
#: Share of the known neighbours of ``MEASURED`` sampled rows that searches have to meet; as large a share of these rows
#: has to meet ``EACH`` of its own.
RECALL, MEASURED, EACH = 0.96, 200, 0.9
#: Rows or queries in a block.
BLOCK = 4096
#: Searches of one task.
TASK_QUERIES = 1000
SEED = 11


def taking_part(x: Column) -> Column:
    """Whether a vector is not null, empty or zero and all its components are finite."""
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    if all(len(p) == 8 * width for p in packed):
        return np.frombuffer(b"".join(packed)).reshape(len(packed), width)
    out = np.zeros((len(packed), width))
    for i, p in enumerate(packed):
        out[i, :len(p) // 8] = np.frombuffer(p)
    return out


def chance_below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about three digits."""
    return 0.5 * (1 + np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z ** 3)))


class Forest:
    """Trees fitted on a sample. Nodes of all trees stand in arrays; a child below 0 is leaf ``-1 - child``."""

    def __init__(self, sample: np.ndarray, largest: float, scale: float, trees: int, leaf: int):
        self.scale, self.largest, self.width = scale, largest, sample.shape[1]
        points, rng = self.raised(sample), np.random.default_rng(SEED)
        self.mean = points.mean(axis=0)
        self.covariance = np.cov(points.T, bias=True).reshape(len(self.mean), -1)
        self.points, ways, medians, self.children, self.roots = points, [], [], [], []
        self.member, self.sizes = np.empty((len(points), trees), np.int64), []  # the sample's own leaves, and its rows in each leaf

        def grow(rows: np.ndarray, tree: int) -> int:
            way = rng.normal(size=points.shape[1])
            way /= np.linalg.norm(way)
            p = points[rows] @ way
            middle = np.median(p)
            low = p < middle
            if len(rows) <= max(leaf, 1) or not low.any():  # not to be parted: all on one side
                self.member[rows, tree] = len(self.sizes)
                self.sizes.append(len(rows))
                return -len(self.sizes)
            node = len(ways)
            ways.append(way)
            medians.append(middle)
            self.children.append(None)
            self.children[node] = (grow(rows[low], tree), grow(rows[~low], tree))
            return node

        for tree in range(trees):
            self.roots.append(grow(np.arange(len(points)), tree))
        self.ways, self.medians = np.array(ways).reshape(-1, points.shape[1]), np.array(medians)
        # what the chances need of each node, whatever the query
        self.from_mean, self.half = self.ways @ self.mean, self.ways @ self.covariance
        self.spread = np.einsum("ij,ij->i", self.half, self.ways)

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors with one more component, whose cosines are in the order of the inner products."""
        x = x / self.scale / self.largest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in each tree."""
        points = self.raised(x)
        out = np.empty((len(points), len(self.roots)), np.int64)

        def down(node: int, rows: np.ndarray, tree: int) -> None:
            if node < 0:
                out[rows, tree] = -1 - node
            elif len(rows):
                low = points[rows] @ self.ways[node] < self.medians[node]
                down(self.children[node][0], rows[low], tree)
                down(self.children[node][1], rows[~low], tree)

        for tree, root in enumerate(self.roots):
            down(root, np.arange(len(points)), tree)
        return out

    def chances(self, x: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        """For each query the chance of each node that a neighbour lies on its lower side; its cosines to the sample; the
        rank in the sample that k has among all rows (the query itself aside); its norm."""
        norm = np.linalg.norm(x / self.scale, axis=1)
        units = np.column_stack([x / self.scale / np.where(norm > 0, norm, 1)[:, None], np.zeros(len(x))])
        near = units @ self.points.T
        rank = min(near.shape[1] - 1, max(1, k * near.shape[1] // max(rows, 1)))
        wanted = np.clip(-np.partition(-near, rank, axis=1)[:, rank], -0.999, 0.999999)
        along, mean, shared = units @ self.ways.T, units @ self.mean, units @ self.half.T
        own = np.einsum("ij,jk,ik->i", units, self.covariance, units)
        left = np.sqrt((1 - wanted ** 2) / np.maximum(1e-12, 1 - own - mean ** 2))[:, None]
        spread = np.maximum(self.spread - 2 * along * shared + along ** 2 * own[:, None], 1e-18)
        centre = wanted[:, None] * along + left * (self.from_mean - mean[:, None] * along)
        return chance_below((self.medians - centre) / (left * np.sqrt(spread))), near, rank, norm

    def measure(self, k: int, rows: int, recall: float) -> None:
        """Set the limit at which searches end by what sampled rows need to meet their neighbours in the sample."""
        some = np.unique(np.linspace(0, len(self.points) - 1, MEASURED).astype(int))
        low, near, rank, _ = self.chances(self.points[some, :-1] * self.largest * self.scale, k, rows)
        missed = []
        for i, own in enumerate(some):
            near[i, own] = -np.inf
            known = np.argpartition(-near[i], rank - 1)[:rank]
            after = np.empty(len(self.sizes))
            for leaf, miss in self.walk(low[i]):
                after[leaf] = miss
            missed.append(after[self.member[known]].max(axis=1))
        self.limit = -1.0
        if recall <= 1 and len(some) > 1:
            each = [np.quantile(m, 1 - EACH, method="lower") for m in missed]
            self.limit = float(min(np.quantile(np.concatenate(missed), 1 - recall, method="lower"), np.quantile(each, 1 - recall, method="lower")))

    def queries(self, x: np.ndarray, k: int, rows: int) -> list[tuple[list[int], float]]:
        """For each query its leaves, and a score that the k + 1 best found can't be below: that of the k + 1st sampled row in these leaves."""
        low, near, _, norm = self.chances(x, k, rows)
        out = []
        for i in range(len(x)):
            leaves, floor = self.search(low[i], k + 1), -np.inf
            met = np.zeros(len(self.sizes), bool)
            met[leaves] = True
            scores = near[i, met[self.member].any(axis=1)]
            if len(scores) > k:
                floor = -np.partition(-scores, k)[k] - 1e-9
                floor *= norm[i] * self.largest * self.scale * self.scale
            out.append((leaves, float(floor)))
        return out

    def search(self, low: np.ndarray, least: int) -> list[int]:
        """The leaves of a search: until the chance of having missed a neighbour is at the limit, and ``least`` sampled rows are met."""
        held, taken = 0, []
        for leaf, miss in self.walk(low):
            taken.append(leaf)
            held += self.sizes[leaf]
            if miss <= self.limit and held >= least * len(self.roots):
                break
        return taken

    def walk(self, low: np.ndarray) -> Iterator[tuple[int, float]]:
        """All leaves by falling chance, from one queue over all trees, with the chance that a neighbour is in none so far."""
        queue = [(-1.0, tree, root) for tree, root in enumerate(self.roots)]
        heapq.heapify(queue)
        missed, low = [1.0] * len(self.roots), low.tolist()
        while queue:
            chance, tree, node = heapq.heappop(queue)
            if node < 0:
                missed[tree] = max(0.0, missed[tree] + chance)
                yield -1 - node, math.prod(missed)
                continue
            below, above = self.children[node]
            heapq.heappush(queue, (chance * low[node], tree, below))
            heapq.heappush(queue, (chance * (1 - low[node]), tree, above))


def fit(classes: DataFrame, trees: int, leaf: int, sample: int, k: int, recall: float) -> tuple[Forest, int] | None:
    """The forest of a table of distinct vectors, and their number. The sample is the rows of smallest hash."""
    rows, width, scale = classes.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not rows:
        return None
    # scaled, so that no square overflows
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + (v / scale) * (v / scale)))
    largest = classes.agg(F.max(norm)).first()[0]
    size = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
    drawn = classes.orderBy(F.xxhash64("rep", F.lit(SEED)), "rep").limit(size).select("x").collect()  # bounded by size
    points = matrix([np.asarray(r.x, np.float64).tobytes() for r in drawn], width)
    forest = Forest(points, largest, scale, trees, max(SAMPLED_LEAF, leaf * len(points) // rows))
    forest.measure(k, rows, recall)
    return forest, rows


def leaf_rows(forest) -> Callable:
    def put(batches):
        for pdf in batches:
            if len(pdf):
                x = matrix([np.asarray(v, np.float64).tobytes() for v in pdf["x"]], forest.value.width)
                leaves = forest.value.leaves_of(x)
                packed = [row.tobytes() for row in x]
                for tree in range(leaves.shape[1]):
                    yield pd.DataFrame({"leaf": leaves[:, tree], "rep": pdf["rep"], "ids": pdf["ids"], "packed": packed})

    return put


def visits(forest, k: int, rows: int) -> Callable:
    def visit(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at:at + 256]
                x = matrix([np.asarray(v, np.float64).tobytes() for v in some["x"]], forest.value.width)
                for q, row, (leaves, floor) in zip(some["query"], x, forest.value.queries(x, k, rows)):
                    yield pd.DataFrame({"leaf": leaves, "query": q, "floor": floor, "q": row.tobytes()})

    return visit


def rerank(k: int, width: int) -> Callable:
    """Exact scores of a block of a leaf's rows for a block of the queries that visit it; of each query the k + 1 best classes."""
    def scored(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "ids": pd.Series(dtype=object)})
        if not len(rows) or not len(queries):
            return none
        x, reps = matrix(list(rows["packed"]), width), rows["rep"].to_numpy()
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(queries), 256):
                some = queries.iloc[at:at + 256]
                q, floors = matrix(list(some["q"]), width), some["floor"].to_numpy()
                close = q @ x.T
                reach = floors - 1e-9 * np.abs(floors)
                for i in range(len(some)):
                    found = np.flatnonzero(~(close[i] < reach[i]))
                    # the score itself does not depend on what else is in the block
                    score = (x[found] * q[i]).sum(axis=1)
                    best = np.lexsort((reps[found], -score))[:k + 1]
                    out.append((np.full(len(best), some["query"].iloc[i]), found[best], score[best]))
        which = np.concatenate([o[1] for o in out])
        return pd.DataFrame({"query": np.concatenate([o[0] for o in out]), "rep": reps[which], "score": np.concatenate([o[2] for o in out]), "ids": rows["ids"].to_numpy()[which]})

    return scored


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, x): distinct vectors with their k + 1 smallest ids; of a vector with very many copies a task sees few."""
    near = Window.partitionBy("x").orderBy("id")
    few = rows.select("id", "x").withColumn("r", F.dense_rank().over(near)).where(F.col("r") <= k + 1)
    return few.groupBy("x").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "x")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product that each query found, ties to the smaller id.

    ``is_query`` is a condition on ``key``. A query's candidates are all rows but those of its own id. Rows with a null
    key, and vectors that are null, empty, zero or hold null or non-finite components take no part. A shorter vector
    counts as filled with zeros. Equal rows count once; an id with several vectors is found by the best of
    them and, as a query, searched by the one that is smallest in order. Other columns are not read.
    Neighbours are found with about the chance ``recall`` (over 1: all leaves are visited); what is found has exact scores.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = stored(vectors.select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("x"), is_query.alias("asks"))
                  .where(F.col("id").isNotNull() & taking_part(F.col("x"))), "vectors")
    classes = stored(classes_of(rows, k), "classes")
    fitted = fit(classes, trees, leaf, sample, k, recall)
    if fitted is None:
        return empty
    forest, number = fitted
    sent = spark.sparkContext.broadcast(forest)
    asked = rows.where("asks").groupBy("id").agg(F.min("x").alias("x"))
    groups = stored(asked.groupBy("x").agg(F.min("id").alias("query")), "queries")
    queries = stored(asked.join(groups, "x").select("id", "query"), "asked")
    index = stored(classes.mapInPandas(leaf_rows(sent), "leaf long, rep long, ids array<long>, packed binary"), "forest")
    tasks = math.ceil(groups.count() / TASK_QUERIES)  # searches are long for their bytes
    asks = stored(groups.repartition(max(1, tasks), "query").mapInPandas(visits(sent, k, number), "leaf long, query long, floor double, q binary"), "visits")
    parts = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = stored(parts(index, "row_blocks").join(parts(asks, "query_blocks"), "leaf"), "sizes")

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        return df.join(sizes, "leaf").withColumn(own[:-1], F.pmod(F.xxhash64(by), F.col(own)).cast("int")) \
            .withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    keys = ["leaf", "row_block", "query_block"]
    left = dealt(index, "rep", "row_blocks", "query_blocks").select(*keys, "rep", "ids", "packed")
    right = dealt(asks, "query", "query_blocks", "row_blocks").select(*keys, "query", "floor", "q")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank(k, forest.width), "query long, rep long, score double, ids array<long>")
    # a class met in several trees has the same score in all; an id of several classes counts by the best
    pairs = found.groupBy("query", "rep").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    by_id = pairs.select("query", "score", F.explode("ids").alias("id")).groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = by_id.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1) \
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b.id != F.col("query_id")), 1, k)
    return queries.withColumnRenamed("id", "query_id").join(stored(best, "best"), "query").select("query_id", F.posexplode(others).alias("i", "b")) \
        .select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
