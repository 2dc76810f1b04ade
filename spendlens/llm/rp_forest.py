"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Equal vectors of one label are one class first. Each tree splits the classes of a label at the
median of a random projection, again and again until a node is small; classes near the median go
to both sides, so a close pair is seldom parted in a tree and all but never in every tree. Within
the leaves all pairs are verified by cosine; links are joined to components. A node that no
projection can part (more than half of it lies near the median each time) is compared in pairs of
blocks, each a task of its own, so no pair is given up and no task grows with the node.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, stored
from .gray_simhash import smallest_reachable

TREES = 4
#: Classes in a leaf, and in a block of a node that can't be parted.
LEAF = 256
#: Half width of the overlap, in standard deviations of the projected distance of a pair at the threshold.
SPILL = 1.0
#: Levels beyond those that halving would need.
MORE_LEVELS = 8
SEED = 7


def directions(tree: int, levels: int, width: int) -> np.ndarray:
    """A random unit vector for each level of a tree."""
    made = np.random.default_rng([SEED, tree]).normal(size=(levels, width))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def _unit(packed: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed)).reshape(len(packed), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linkable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, x): rows that may link: id and label set, components finite and not null, not all zero."""
    x = F.col(f"`{vector}`").cast("array<double>")
    return vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), x.alias("x")) \
        .where("id is not null and label is not null and size(x) > 0") \
        .where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))) \
        .where(F.exists("x", lambda v: v != 0)) \
        .withColumn("label", F.concat(F.size("x").cast("string"), F.lit(":"), "label"))


def _packed(x: pd.Series) -> pd.Series:
    return x.map(lambda v: np.asarray(v, np.float64).tobytes())


def grow(classes: DataFrame, cosine: float, trees: int, leaf: int) -> DataFrame:
    """(rep, leaf): the leaves of every class, at least one in each tree."""
    spark = classes.sparkSession
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.length("packed")) / 8, F.lit(1)).cast("int")).first()
    levels = max(1, math.ceil(math.log2(max(2, n / leaf))) + MORE_LEVELS)
    reach = math.sqrt(2 - 2 * cosine)

    @F.pandas_udf("array<array<float>>")
    def projected(packed: pd.Series) -> pd.Series:
        out = []
        for dims, rows in packed.groupby(packed.str.len()):
            x = _unit(list(rows))
            all_ways = np.stack([x @ directions(t, levels, dims // 8).T for t in range(trees)], axis=1).astype(np.float32)
            out.append(pd.Series([[list(p) for p in row] for row in all_ways], index=rows.index))
        return pd.concat(out).reindex(packed.index) if out else pd.Series([], dtype=object)

    band = F.lit(SPILL * reach) / F.sqrt(F.col("dims"))
    rows = stored(classes.select("rep", "label", F.length("packed") / 8, projected("packed").alias("all")).toDF("rep", "label", "dims", "all")
                  .select("rep", "dims", F.posexplode("all").alias("tree", "p"), "label")
                  .select("rep", "dims", F.xxhash64("tree", "label").alias("node"), "p"), "roots")
    leaves = []
    for level in range(levels):
        at = F.col("p")[level]
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("n"), F.percentile_approx(at, [0.25, 0.5, 0.75], 1000).alias("q"), F.max("dims").alias("dims"))
                       .where(f"n > {int(leaf)}")
                       .select("node", F.when(F.col("q")[2] - F.col("q")[0] > 2 * band, F.col("q")[1]).alias("median")), "sizes")
        if sizes.isEmpty():
            break
        leaves.append(rows.join(sizes, "node", "left_anti").select("rep", "node"))
        side = lambda s: F.xxhash64("node", F.lit(s))
        parted = rows.join(sizes, "node").select(
            "rep", "dims", "p",
            F.explode(F.when(F.col("median").isNull(), F.array("node")).otherwise(F.filter(F.array(
                F.when(at < F.col("median") + band, side(0)), F.when(at >= F.col("median") - band, side(1))),
                lambda c: c.isNotNull()))).alias("node"))
        rows = stored(parted.select("rep", "dims", "node", "p"), "level")
    out = rows.select("rep", "node")
    for part in leaves:
        out = out.unionByName(part)
    return stored(out.withColumnRenamed("node", "leaf"), "leaves")


def _compare(cosine: float):
    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that this pair of blocks owns: for each class how many vectors, and a star for each component."""
        own_leaf, one, two = key
        x = _unit(list(pdf["packed"]))
        rep, n, block = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy()
        near = x @ x.T >= cosine
        if one != two:
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        # a pair that meets in several leaves counts in the one with the smallest id
        owner = np.repeat(np.arange(len(pdf)), pdf["leaves"].str.len())
        held = np.concatenate(list(pdf["leaves"]))
        earlier = held < own_leaf
        _, which = np.unique(held[earlier], return_inverse=True)
        member = np.zeros((len(pdf), which.max() + 1 if len(which) else 1), np.float32)
        member[owner[earlier], which] = 1
        counts = (near & (member @ member.T == 0)) @ n
        a, b = np.nonzero(np.triu(near))
        root = smallest_reachable(len(pdf), a, b)
        linked = near.any(axis=1)
        return pd.DataFrame({"rep": rep[linked], "count": counts[linked], "root": rep[root][linked]})

    return compare


def embedding_components(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                         cosine: float = 0.98, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Vectors link when their labels are equal and not null, they have as many components, and their
    cosine in double precision is at least ``cosine``. Null, empty and zero vectors, vectors with a
    null or non-finite component, and rows with a null key link with nothing: no links, their own
    component, kept. Repeated rows are vectors of their own that link with each other. An id that
    stands for several vectors is one node. Other columns are not read.
    """
    usable = stored(linkable(vectors, key, vector, label), "vectors")
    pack = F.pandas_udf(_packed, "binary")
    classes = stored(usable.groupBy("label", "x").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
                     .select("label", "rep", "n", pack("x").alias("packed"), "x"), "classes")
    leaves = grow(classes.select("rep", "label", "packed"), cosine, trees, leaf).distinct()
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1")
    blocks = sizes.select("leaf", F.ceil(F.col("m") / leaf).cast("int").alias("blocks"))
    of_rep = leaves.groupBy("rep").agg(F.collect_set("leaf").alias("leaves"))
    known = classes.select("rep", "n", "packed").join(of_rep, "rep")
    rows = leaves.join(blocks, "leaf").join(known, "rep") \
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rep", "n", "packed", "leaves")
    found = stored(rows.groupBy("leaf", "one", "two").applyInPandas(_compare(cosine), "rep long, count long, root long"), "found")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("count").alias("count"))
    named = stored(classes.select("label", "x", "rep", "n").join(counts, "rep", "left")
                   .join(components.withColumnRenamed("node", "rep"), "rep", "left")
                   .select("label", "x", (F.coalesce("count", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    linked = usable.join(named, ["label", "x"]).select(F.col("id").alias(key), "n_links", "component_id")
    forget(found)
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.col(f"`{key}`").isNull() | F.col(f"`{label}`").isNull() | F.coalesce(F.size(x) <= 0, F.lit(True)) \
        | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    single = vectors.where(F.coalesce(bad, F.lit(True))).select(
        F.col(f"`{key}`").cast("long").alias(key), F.lit(0).cast("long").alias("n_links"), F.col(f"`{key}`").cast("long").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
