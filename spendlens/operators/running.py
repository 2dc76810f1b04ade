"""Skew-safe running aggregates over ordered groups.

A plain ``Window.partitionBy(key).orderBy(t).rowsBetween(unboundedPreceding, -1)``
puts every row of a key into one task.  A single user (or model, or merchant)
may own a third of all rows, so here every ordered group is cut into
*buckets* -- a monotone function of the order key (a day, an id range).  The
work is then:

1. aggregate per (group, bucket)              -- map-side partial aggregation
2. prefix-combine the bucket table per group  -- one row per bucket, small
3. join the prefix back on (group, bucket) and finish with a window inside
   each bucket                                 -- tasks are (group, bucket)

The result is exactly the ROWS-frame answer of the single big window.  Means
and variances are merged with the parallel (Chan et al.) update around a
per-group pivot so that constant series keep a variance of exactly zero.

Group keys may be NULL (NULL forms its own group, as in a window); they are
carried as (is_null, coalesced-string) pairs so joins stay plain equi-joins
and the join's hash partitioning is reused by the bucket window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.operators.joinback import FLOOR, dealt, split_hot

_UNB = Window.unboundedPreceding


def _keyed(df: DataFrame, cols: Sequence[str], tag: str) -> tuple[DataFrame, list[str]]:
    names = []
    for i, c in enumerate(cols):
        n, v = f"__{tag}{i}n", f"__{tag}{i}v"
        df = df.withColumn(n, F.col(c).isNull()).withColumn(
            v, F.coalesce(F.col(c).cast("string"), F.lit("")))
        names += [n, v]
    return df, names


def _drop_internal(df: DataFrame, tag: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(f"__{tag}")])


def running_row_number(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str],
                       bucket: Column, out_col: str) -> DataFrame:
    """``row_number() over (partition by part order by order_cols)`` without a
    per-group task.  ``bucket`` must be non-decreasing in the order."""
    tag = "rn"
    d, g = _keyed(df, part_cols, tag)
    b = f"__{tag}_b"
    d = d.withColumn(b, bucket)
    counts = d.groupBy(*g, b).agg(F.count(F.lit(1)).alias(f"__{tag}_bn"))
    wb = Window.partitionBy(*g).orderBy(b).rowsBetween(_UNB, -1)
    prefix = counts.select(*g, b, F.coalesce(F.sum(f"__{tag}_bn").over(wb), F.lit(0))
                           .alias(f"__{tag}_before"))
    wr = Window.partitionBy(*g, b).orderBy(*order_cols)
    d = d.withColumn(f"__{tag}_local", F.row_number().over(wr))   # window first: no re-sort
    j = d.join(prefix, on=[*g, b])
    out = j.withColumn(out_col, F.col(f"__{tag}_before") + F.col(f"__{tag}_local"))
    return _drop_internal(out, tag)


def running_prior_max(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str],
                      bucket: Column, value: Column, out_col: str) -> DataFrame:
    """max(value) over rows strictly before each row in its group (NULL if none)."""
    tag = "mx"
    d, g = _keyed(df, part_cols, tag)
    b, v = f"__{tag}_b", f"__{tag}_v"
    d = d.withColumn(b, bucket).withColumn(v, value)
    per_bucket = d.groupBy(*g, b).agg(F.max(v).alias(f"__{tag}_bmax"))
    wb = Window.partitionBy(*g).orderBy(b).rowsBetween(_UNB, -1)
    prefix = per_bucket.select(*g, b, F.max(f"__{tag}_bmax").over(wb).alias(f"__{tag}_pmax"))
    wr = Window.partitionBy(*g, b).orderBy(*order_cols).rowsBetween(_UNB, -1)
    d = d.withColumn(f"__{tag}_wmax", F.max(v).over(wr))          # window first: no re-sort
    j = d.join(prefix, on=[*g, b])
    out = j.withColumn(out_col, F.greatest(F.col(f"__{tag}_pmax"), F.col(f"__{tag}_wmax")))
    return _drop_internal(out, tag)


def bucket_moments(d: DataFrame, g: list[str], b: str, value: str, tag: str) -> DataFrame:
    """Step 1+2: per (group, bucket) n / mean / M2, then the Chan-merged
    moments of all *earlier* buckets of the group (centred on the group's
    first bucket mean).  Map-side partial aggregation keeps the shuffle small."""
    x = F.col(value)
    bn, bmean, bm2 = f"__{tag}_bn", f"__{tag}_bmean", f"__{tag}_bm2"
    buckets = d.groupBy(*g, b).agg(
        F.count(x).alias(bn), F.avg(x).alias(bmean),
        (F.var_pop(x) * F.count(x)).alias(bm2))
    return prefix_moments(buckets, g, b, tag)


def prefix_moments(buckets: DataFrame, g: list[str], b: str, tag: str) -> DataFrame:
    bn, bmean, bm2 = f"__{tag}_bn", f"__{tag}_bmean", f"__{tag}_bm2"
    piv, pn, pd1, pd2 = f"__{tag}_piv", f"__{tag}_pn", f"__{tag}_pd1", f"__{tag}_pd2"
    wfirst = Window.partitionBy(*g).orderBy(b).rowsBetween(_UNB, Window.currentRow)
    wprev = Window.partitionBy(*g).orderBy(b).rowsBetween(_UNB, -1)
    buckets = buckets.withColumn(piv, F.first(F.col(bmean), ignorenulls=True).over(wfirst))
    dev = F.col(bmean) - F.col(piv)
    return buckets.select(
        *g, b, piv,
        F.coalesce(F.sum(bn).over(wprev), F.lit(0)).alias(pn),
        F.sum(F.when(F.col(bn) > 0, F.col(bn) * dev).otherwise(0.0)).over(wprev).alias(pd1),
        F.sum(F.when(F.col(bn) > 0, F.col(bm2) + F.col(bn) * dev * dev).otherwise(0.0))
         .over(wprev).alias(pd2))


def apply_prior_moments(d: DataFrame, pre: DataFrame, g: list[str], b: str,
                        order_cols: Sequence[str], value: str, tag: str,
                        prefix: str) -> DataFrame:
    """Step 3: join the earlier-bucket moments and merge with the running
    moments inside the row's own bucket."""
    x = F.col(value)
    piv, pn, pd1, pd2 = f"__{tag}_piv", f"__{tag}_pn", f"__{tag}_pd1", f"__{tag}_pd2"
    # window inside the bucket first: its output is already clustered and
    # sorted on (group, bucket), so the join that follows needs no extra sort
    wr = Window.partitionBy(*g, b).orderBy(*order_cols).rowsBetween(_UNB, -1)
    wn, wmean, wm2 = f"__{tag}_wn", f"__{tag}_wmean", f"__{tag}_wm2"
    d = (d.withColumn(wn, F.count(x).over(wr))
          .withColumn(wmean, F.avg(x).over(wr))
          .withColumn(wm2, F.var_pop(x).over(wr) * F.col(wn)))
    j = d.join(pre, on=[*g, b])

    P, W = F.col(pn).cast("double"), F.col(wn).cast("double")
    p_mean = F.col(piv) + F.try_divide(F.col(pd1), P)
    p_m2 = F.col(pd2) - F.try_divide(F.col(pd1) * F.col(pd1), P)
    n = P + W
    delta = F.col(wmean) - p_mean
    mean = (F.when(W == 0, p_mean).when(P == 0, F.col(wmean))
             .otherwise(p_mean + F.try_divide(delta * W, n)))
    m2 = (F.when(W == 0, p_m2).when(P == 0, F.col(wm2))
           .otherwise(p_m2 + F.col(wm2) + F.try_divide(delta * delta * P * W, n)))
    return _drop_internal(_with_stats(j, prefix, F.col(pn) + F.col(wn), mean, m2), tag)


def _with_stats(d: DataFrame, prefix: str, count: Column, mean: Column, m2: Column) -> DataFrame:
    """Adds ``{prefix}_n``, ``{prefix}_mean`` and ``{prefix}_std`` from moments."""
    n = count.cast("double")
    var = F.try_divide(F.greatest(m2, F.lit(0.0)), n - 1)
    std = F.when(n >= 2, F.sqrt(var)).otherwise(F.lit(0.0))
    # merging floating partial sums can leave ~1 ulp of residue on a constant
    # series; a spread below 1e-12 of the mean is treated as exactly zero
    std = F.when(std <= F.lit(1e-12) * F.greatest(F.abs(mean), F.lit(1.0)), F.lit(0.0)).otherwise(std)
    return (d.withColumn(f"{prefix}_n", count.cast("bigint"))
             .withColumn(f"{prefix}_mean", F.when(n > 0, mean))
             .withColumn(f"{prefix}_std", F.when(n > 0, std).otherwise(F.lit(0.0))))


def prior_stats(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str],
                bucket: Column, value: str, prefix: str) -> DataFrame:
    """Count, mean and sample standard deviation of ``value`` over the rows
    strictly before each row of its group (ROWS frame, order = order_cols).

    Adds ``{prefix}_n`` (bigint), ``{prefix}_mean`` (NULL when n = 0) and
    ``{prefix}_std`` (0.0 when n < 2).
    """
    tag = f"ps{prefix}"
    d, g = _keyed(df, part_cols, tag)
    b = f"__{tag}_b"
    d = d.withColumn(b, bucket)
    pre = bucket_moments(d, g, b, value, tag)
    return apply_prior_moments(d, pre, g, b, order_cols, value, tag, prefix)


def prior_stats_pair(df: DataFrame, user: str, keys: tuple[str, str], order_cols: Sequence[str],
                     bucket: Column, value: str, prefixes: tuple[str, str], floor: int = FLOOR) -> DataFrame:
    """``prior_stats`` for two keys under one user column; ``df`` is a stored table.

    The rows of users that fit one task are dealt by user once, and both keys' windows run
    there; only the rows of hot users (``joinback.split_hot``) are cut into buckets."""
    usual, hot = split_hot(df, user, floor)
    return _pair_by_user(usual, user, keys, order_cols, bucket, value, prefixes, df).unionByName(
        _pair_by_bucket(hot, user, keys, order_cols, bucket, value, prefixes))


def _pair_by_user(df: DataFrame, user: str, keys: tuple[str, str], order_cols: Sequence[str],
                  bucket: Column, value: str, prefixes: tuple[str, str], of: DataFrame | None = None) -> DataFrame:
    x = F.col(value)
    d = dealt(df.withColumn("__un", F.col(user).isNull()).withColumn("__b", bucket), df if of is None else of, "__un", user)
    for key, p in zip(keys, prefixes):
        w = Window.partitionBy("__un", user, F.col(key).isNull(), key).orderBy(*order_cols).rowsBetween(_UNB, -1)
        d = d.withColumn("__wn", F.count(x).over(w)).withColumn("__wmean", F.avg(x).over(w)).withColumn("__wvar", F.var_pop(x).over(w))
        d = _with_stats(d, p, F.col("__wn"), F.col("__wmean"), F.col("__wvar") * F.col("__wn")).drop("__wn", "__wmean", "__wvar")
    # rows without a bucket count as prior rows but have no result, as among hot users
    return d.where("__b is not null").drop("__un", "__b")


def _pair_by_bucket(df: DataFrame, user: str, keys: tuple[str, str], order_cols: Sequence[str],
                    bucket: Column, value: str, prefixes: tuple[str, str]) -> DataFrame:
    """``prior_stats`` for two keys under one user column, computing both
    bucket tables in a single grouping-sets aggregate (one scan of the input
    instead of two)."""
    tags = [f"ps{p}" for p in prefixes]
    d = df
    gs = []
    for k, t in zip(keys, tags):
        d, g = _keyed(d, [user, k], t)
        gs.append(g)
    b = "__psb"
    d = d.withColumn(b, bucket)
    x = F.col(value)
    # one Expand + one shuffle for both (user, key, bucket) groupings
    grp = F.grouping_id().alias("__gid")
    cols = sorted(set(gs[0] + gs[1]))
    agg = (d.groupingSets([gs[0] + [b], gs[1] + [b]], *cols, b)
            .agg(grp, F.count(x).alias("__bn"), F.avg(x).alias("__bmean"),
                 (F.var_pop(x) * F.count(x)).alias("__bm2")))
    out = d
    all_cols = cols + [b]  # grouping_id bit order: first column = most significant
    for t, g, p in zip(tags, gs, prefixes):
        other = [c for c in all_cols if c not in g and c != b]
        gid = sum(1 << (len(all_cols) - 1 - all_cols.index(c)) for c in other)
        part = (agg.where(F.col("__gid") == gid)
                   .select(*g, F.col(b).alias(f"__{t}_b"), F.col("__bn").alias(f"__{t}_bn"),
                           F.col("__bmean").alias(f"__{t}_bmean"),
                           F.col("__bm2").alias(f"__{t}_bm2")))
        pre = prefix_moments(part, g, f"__{t}_b", t)
        out = out.withColumn(f"__{t}_b", F.col(b))
        out = apply_prior_moments(out, pre, g, f"__{t}_b", order_cols, value, t, p)
    return out.drop(b)
