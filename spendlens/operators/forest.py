"""Isolation forest on Spark (M10-M14): fit, score, threshold.

Spark has no isolation forest, so this follows the published algorithm
(Liu, Ting & Zhou, 2008) with the usual defaults: 200 trees, 256 samples per
tree drawn without replacement, height limit ceil(log2(256)), score
``-2^(-E[h(x)] / c(psi))`` and an offset at the ``contamination`` quantile of
the training scores.

How it maps onto Spark:

* **Sampling** -- partition-independent and bounded by parameters, never by
  data: a hash-selected candidate pool of about ``trees * samples`` rows
  (``xxhash64(id, seed)`` below a threshold, so any cluster layout picks the
  same rows), then per tree the ``samples`` rows with the smallest
  ``xxhash64(id, seed, tree)`` -- a ``row_number() <= k`` filter that Spark
  turns into a per-partition WindowGroupLimit.
* **Growing** -- ``groupBy(tree).applyInPandas``: each tree is one small
  pandas task (256 rows), 200 trees grow in parallel.
* **Scoring** -- the node table is at most ``trees * (2 * samples - 1)`` rows
  (102,200 for the defaults; fixed by parameters), so it is broadcast once;
  ``mapInArrow`` walks tree after tree for slices of an Arrow batch with numpy.
* **Threshold** -- the exact interpolated quantile of all training scores, by
  rounds of bounded counts (no task holds every score).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from spendlens.operators.quantile import exact_quantile
from spendlens.session import stored

# ---- fixed values: model parameters of the reference ----
N_TREES = 200
MAX_SAMPLES = 256
CONTAMINATION = 0.05
SEED = 42
# ---------------------------------------------------------
EULER_GAMMA = 0.5772156649015329
POOL_SLACK = 1.25          # candidate pool oversampling before the exact top-k

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size int, depth int")


def avg_path_length(n: np.ndarray | float) -> np.ndarray | float:
    """c(n): average unsuccessful-search path length in a binary search tree."""
    n_arr = np.asarray(n, dtype=float)
    out = np.zeros_like(n_arr)
    two = n_arr == 2
    big = n_arr > 2
    out[two] = 1.0
    nb = n_arr[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out if np.ndim(n) else float(out)


@dataclass
class ForestModel:
    features: list[str]
    means: list[float]
    scales: list[float]
    nodes: pd.DataFrame               # the node table (bounded by parameters)
    psi: int                          # samples per tree actually used
    offset: float = 0.0
    params: dict = field(default_factory=dict)


def standardize(df: DataFrame, features: list[str], means: list[float], scales: list[float],
                prefix: str = "__z_") -> DataFrame:
    """(x - mean) / scale with population std (scale 1 when std is 0)."""
    return df.select("*", *[((F.col(f) - F.lit(m)) / F.lit(s)).alias(prefix + f)
                            for f, m, s in zip(features, means, scales)])


def fit_scaler(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """One global aggregate; 2 numbers per feature come back to the driver."""
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                 *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    means = [float(row[f"m{i}"] or 0.0) for i in range(len(features))]
    scales = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(features))]
    return means, scales


def _grow(pdf: pd.DataFrame, cols: list[str], seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    pdf = pdf.sort_values("__h")            # order-independent input
    X = pdf[cols].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    rows = []

    def build(idx: np.ndarray, depth: int) -> int:
        node = len(rows)
        rows.append(None)
        sub = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(cand[rng.integers(cand.size)])
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        rows[node] = (tree, node, f, thr, left, right, len(idx), depth)
        return node

    build(np.arange(len(X)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                       "size", "depth"])


def fit_forest(df: DataFrame, features: list[str], id_col: str, n_trees: int = N_TREES,
               max_samples: int = MAX_SAMPLES, seed: int = SEED,
               contamination: float = CONTAMINATION) -> tuple[ForestModel, DataFrame]:
    """M11 + M13: returns the model and the training rows with their scores."""
    # M10 is fitted and kept with the model for parity, but trees are grown on
    # the raw features: isolation splits are scale-equivariant (threshold =
    # lo + u * (hi - lo)), and raw values make the forest independent of how
    # floating-point sums were partitioned
    means, scales = fit_scaler(df, features)
    z = df
    zcols = list(features)
    n = df.count()
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    # candidate pool: one hash per row, kept when below a threshold sized so
    # the pool holds ~POOL_SLACK * trees * psi rows (bounded by parameters)
    pool_size = n_trees * psi
    frac = min(1.0, POOL_SLACK * pool_size / max(n, 1))
    pool = z.select(F.col(id_col).cast("string").alias("__id"), *zcols)
    if frac < 1.0:
        pool = pool.where(_unit(F.xxhash64("__id", F.lit(seed))) < F.lit(frac))
    # per tree: pool rows whose tree hash is under a threshold (~1.5 * psi
    # candidates per tree), then the exact psi smallest hashes
    expected_pool = max(1.0, frac * n)
    g = min(1.0, 1.5 * psi / expected_pool)
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: _unit(F.xxhash64(F.col("__id"), F.lit(seed), t)) < F.lit(g))
    per_tree = (pool.select("*", F.explode(trees).alias("tree"))
                    .withColumn("__h", F.xxhash64("__id", F.lit(seed), F.col("tree")))
                    .withColumn("__r", F.row_number().over(
                        Window.partitionBy("tree").orderBy("__h", "__id")))
                    .where(F.col("__r") <= psi)
                    .drop("__r"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return _grow(pdf, zcols, seed, max_depth)

    nodes = (per_tree.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
                     .toPandas())  # <= n_trees * (2 * psi - 1) rows, fixed by parameters
    model = ForestModel(features, means, scales, nodes, psi,
                        params={"n_trees": n_trees, "max_samples": max_samples, "seed": seed,
                                "contamination": contamination})
    # scored training rows feed the quantile and every later consumer (flags,
    # per-user scaling): score once, cut lineage in the shared checkpoint folder
    scored = stored(score(model, df), "scored")
    model.offset = exact_quantile(scored, "score", contamination)
    return model, scored.withColumn("decision", F.col("score") - F.lit(model.offset))


def _unit(h: Column) -> Column:
    """A 64-bit hash mapped to [0, 1)."""
    return F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40)


def _flat(nodes: pd.DataFrame):
    """All trees in one global node array (child links made global)."""
    nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    sizes = nodes.groupby("tree").size()
    base = nodes["tree"].map(sizes.cumsum() - sizes).to_numpy()
    feat = nodes["feature"].to_numpy()
    leaf, own = feat < 0, np.arange(len(nodes))
    # a leaf's children are itself, so every row takes as many steps as the tree is deep
    left = np.where(leaf, own, nodes["left"].to_numpy() + base)
    right = np.where(leaf, own, nodes["right"].to_numpy() + base)
    leaf_value = np.where(leaf, nodes["depth"].to_numpy() + avg_path_length(nodes["size"].to_numpy()), 0.0)
    roots = nodes.index[nodes["node"] == 0].to_numpy()
    return {"feature": np.where(leaf, 0, feat).astype(np.int64), "threshold": nodes["threshold"].to_numpy(float),
            "children": np.stack([left, right], axis=1).ravel().astype(np.int64),
            "leaf_value": leaf_value.astype(float), "roots": roots.astype(np.int64),
            "depths": nodes.groupby("tree")["depth"].max().to_numpy()}


#: Rows walked together: a tree's nodes and a column of so many rows stay in the CPU's caches.
ROWS = 4096


def _path_scores(X: list[np.ndarray], t: dict, c_psi: float) -> np.ndarray:
    """Scores of rows given as columns, tree after tree; all rows go down a level at once and stay at their leaf."""
    out = np.empty(len(X[0]) if X else 0)
    for first in range(0, len(out), ROWS):
        cols = np.concatenate([x[first:first + ROWS] for x in X])
        n = len(cols) // len(X)
        at = np.arange(n)
        leaves = np.empty((len(t["roots"]), n))
        for tree, root in enumerate(t["roots"]):
            idx = np.full(n, root)
            for _ in range(t["depths"][tree]):
                right = ~(cols.take(t["feature"].take(idx) * n + at) <= t["threshold"].take(idx))
                idx = t["children"].take(2 * idx + right)
            leaves[tree] = t["leaf_value"].take(idx)
        out[first:first + n] = -np.power(2.0, -np.ascontiguousarray(leaves.T).mean(axis=1) / c_psi)
    return out


def score(model: ForestModel, df: DataFrame, out_col: str = "score") -> DataFrame:
    """Sklearn-style ``score_samples`` (higher = more normal, in [-1, 0])."""
    spark = df.sparkSession
    flat = _flat(model.nodes)
    bc = spark.sparkContext.broadcast(flat)
    c_psi = float(avg_path_length(model.psi)) or 1.0
    z = df
    zcols = list(model.features)
    keep = list(df.columns)
    schema = StructType(list(df.schema.fields) + [StructField(out_col, DoubleType())])

    def walk(batches):
        for batch in batches:
            X = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=float) for c in zcols]
            values = _path_scores(X, bc.value, c_psi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*keep, out_col])

    return z.mapInArrow(walk, schema)


def decision(model: ForestModel, df: DataFrame) -> DataFrame:
    """M12 + M14: ``decision`` = score - offset; ``is_anomaly`` = decision < 0."""
    s = score(model, df)
    return (s.withColumn("decision", F.col("score") - F.lit(model.offset))
             .withColumn("is_anomaly", F.col("decision") < 0))


def flag(decision: Column | str = "decision") -> Column:
    """Whether a row lies below the threshold."""
    return (F.col(decision) if isinstance(decision, str) else decision) < 0
