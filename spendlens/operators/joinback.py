"""Group statistics put back on rows, safe for hot keys.

An aggregate's exchange is never the join's input, which Spark could not
split: rows are dealt by key *and* salt (a hash of the row), and the
statistics, one row per key, are repeated over their key's salts.

With ``count`` (the column that holds a key's rows) the salts follow from the
measured skew.  A key is hot when it holds more rows than an average shuffle
partition, so there are fewer hot keys than partitions: that list (hash of the
key, salts) has a proven size and is broadcast.  Only hot keys are repeated,
ceil(rows / bound) times each, which adds fewer rows than two per partition,
however many keys there are.  Without ``count`` every key has ``SALTS`` salts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.session import stored

SALTS = 32
#: Keys with no more rows than this are never split.
FLOOR = 1 << 16
#: Rows of one task whose windows sort them, about: so many stay in memory.
TASK_ROWS = 1 << 18


def hot_keys(stats: DataFrame, keys: list[str], count: str, floor: int = FLOOR) -> DataFrame:
    """(__key, __salts): hash and number of salts of every key above the bound; fewer rows than shuffle partitions."""
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = stats.agg(F.sum(count)).scalar()
    bound = F.greatest(F.lit(float(floor)), total / F.lit(float(parts)))
    return (stats.where(F.col(count) > bound)
            .select(F.xxhash64(*keys).alias("__key"), F.ceil(F.col(count) / bound).cast("int").alias("__salts"))
            .groupBy("__key").agg(F.max("__salts").alias("__salts")))


def _with_salts(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``__salts`` of each row's key: both sides take it from one list by one hash, so they agree whatever collides."""
    return (df.withColumn("__key", F.xxhash64(*keys)).join(F.broadcast(hot), "__key", "left")
            .withColumn("__salts", F.coalesce("__salts", F.lit(1))).drop("__key"))


def repeated(stats: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics, those of hot keys once for each salt."""
    return (_with_salts(stats, hot, keys)
            .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts"))


def join_back(rows: DataFrame, stats: DataFrame, keys: list[str], salts: int = SALTS,
              null_safe: bool = False, salt_by: list[str] | None = None,
              count: str | None = None, floor: int = FLOOR) -> DataFrame:
    """Left join of ``stats`` (unique on ``keys``, of the rows' types) onto ``rows``.

    ``null_safe``: NULL keys meet NULL keys; else they find no statistics.
    ``salt_by``: columns whose hash deals the rows (default: all columns).
    ``count``: the column of ``stats`` with the number of rows of a key.
    """
    dealt = F.xxhash64(*(salt_by or rows.columns))

    def salt(n: Column) -> Column:
        return F.pmod(dealt, n).cast("int")

    if count is None:
        left = rows.withColumn("__salt", salt(F.lit(salts)))
        right = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    else:
        stats = stored(stats, "stats")   # read by the total, the list and the join: never aggregated again
        hot = hot_keys(stats, keys, count, floor)
        left = _with_salts(rows, hot, keys).withColumn("__salt", salt(F.col("__salts")))
        right = repeated(stats, hot, keys)
    if not null_safe:
        return left.join(right, [*keys, "__salt"], "left").select(
            *rows.columns, *[c for c in stats.columns if c not in keys])
    right = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], F.col("__salt").alias("__right_salt"),
                         *[c for c in stats.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    cond = reduce(lambda a, b: a & b, same, F.col("__salt") == F.col("__right_salt"))
    return left.join(right, cond, "left").select(*rows.columns, *[c for c in stats.columns if c not in keys])


def split_hot(rows: DataFrame, key: str, floor: int = FLOOR) -> tuple[DataFrame, DataFrame]:
    """``rows`` (a stored table) of keys that fit one task, and those of hot keys (see ``hot_keys``)."""
    stats = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "stats")
    hot = stored(hot_keys(stats, [key], "__n", floor), "hot").select("__key", F.lit(True).alias("__hot"))
    marked = rows.withColumn("__key", F.xxhash64(key)).join(F.broadcast(hot), "__key", "left")
    return tuple(marked.where(c).select(*rows.columns) for c in ("__hot is null", "__hot"))


def dealt(rows: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as ``of``, the stored table they are from, has rows for: their
    number follows the rows and not their compressed bytes, so that no sort grows beyond a task's memory."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-of.count() // TASK_ROWS)), *keys)
