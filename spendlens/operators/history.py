"""Whole-history feature sets (W4a, W4b; A1, A2, J2).

Both map per-(user, key) group statistics back onto every row.  Groups are a
grouped aggregate (partial + final, so a huge user or merchant is combined
map-side) joined back on the keys, hot ones dealt over salts (``joinback``), so a
hot key does not land in one task; a NULL key finds no group, as in a pandas ``groupby``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.operators.joinback import FLOOR, dealt, join_back, split_hot

# fixed value: merchant placeholder of feature set B
UNKNOWN_MERCHANT = "UNKNOWN_MERCHANT"


def group_stats(df: DataFrame, base: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """A1 + A2: count, mean and sample std per group (std NULL for one row).

    The statistics are taken from ``base``, the rows before any join, so that no
    aggregate runs the joins of the one before it again."""
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}_count"),
                                  F.avg(value).alias(f"{prefix}_mean"),
                                  F.stddev_samp(value).alias(f"{prefix}_std"))
    return join_back(df, stats, keys, count=f"{prefix}_count")


def user_stats(df: DataFrame, user: str, key: str, value: str, prefix: str) -> DataFrame:
    """``group_stats`` of rows that are dealt by user, as windows; rows without a user or key find no group."""
    w = Window.partitionBy(user, key)
    known = F.col(user).isNotNull() & F.col(key).isNotNull()
    return df.select("*", *[F.when(known, a.over(w)).alias(f"{prefix}_{n}") for n, a in (
        ("count", F.count(F.lit(1))), ("mean", F.avg(value)), ("std", F.stddev_samp(value)))])


def both_stats(d: DataFrame, user: str, keys: dict[str, str], total: str | None = None, floor: int = FLOOR) -> DataFrame:
    """Statistics of ``amount`` by user and each key (prefix -> key), and with ``total`` the user's rows, on every row of
    a stored table.  Rows of users that fit one task are dealt by user once; those of hot users are joined back."""
    usual, hot = split_hot(d, user, floor)
    base = hot
    usual = dealt(usual, d, user)
    for prefix, key in keys.items():
        usual, hot = user_stats(usual, user, key, "amount", prefix), group_stats(hot, base, [user, key], "amount", prefix)
    if total:
        usual = usual.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(user)))
        hot = join_back(hot, base.groupBy(user).agg(F.count(F.lit(1)).alias(total)), [user], null_safe=True, count=total)
    return usual.unionByName(hot)


def _weekday_day(ts: Column) -> list[Column]:
    return [F.weekday(ts).cast("double").alias("day_of_week"),
            F.dayofmonth(ts).cast("double").alias("day_of_month")]


def features_a(txn: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Merchant key = merchant else description; log1p(|amount|);
    frequencies; z-scores that are 0.0 when the group std is NULL or 0."""
    d = txn.withColumn("merchant_key", F.coalesce("merchant", "description"))
    d = both_stats(d, user_col, {"mk": "merchant_key", "ck": "category"})

    def z(prefix: str) -> Column:
        ok = F.col(f"{prefix}_std").isNotNull() & (F.col(f"{prefix}_std") != 0)
        return F.coalesce(F.when(ok, (F.col("amount") - F.col(f"{prefix}_mean")) / F.col(f"{prefix}_std")),
                          F.lit(0.0))

    freq_m = F.when(F.col("merchant_key").isNotNull(), F.col("mk_count"))
    freq_c = F.when(F.col("category").isNotNull(), F.col("ck_count"))
    return d.select(
        "*", F.log1p(F.abs("amount")).alias("log_amount"), *_weekday_day(F.col("transaction_date")),
        freq_m.cast("double").alias("merchant_frequency"),
        F.when(freq_m == 1, 1).otherwise(0).alias("is_new_merchant"),
        freq_c.cast("double").alias("category_frequency"),
        z("ck").alias("amount_zscore_category"), z("mk").alias("amount_zscore_merchant"),
    ).drop("mk_count", "mk_mean", "mk_std", "ck_count", "ck_mean", "ck_std")


def features_b(txn: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Merchant NULL -> UNKNOWN_MERCHANT; log1p(amount); z-scores with a
    divisor of 1.0 when the group has one row or no spread; frequency ratios."""
    d = txn.withColumn("merchant_b", F.coalesce("merchant", F.lit(UNKNOWN_MERCHANT)))
    d = both_stats(d, user_col, {"mb": "merchant_b", "cb": "category"}, total="__total")

    def z(prefix: str) -> Column:
        n, sd = F.col(f"{prefix}_count"), F.col(f"{prefix}_std")
        s = F.when((n > 1) & (sd > 0), sd).otherwise(F.lit(1.0))
        return (F.col("amount") - F.col(f"{prefix}_mean")) / s

    cat_n = F.when(F.col("category").isNotNull(), F.col("cb_count"))
    return d.select(
        "*", F.log1p("amount").alias("log_amount"),
        z("cb").alias("category_amount_zscore"), z("mb").alias("merchant_amount_zscore"),
        (F.col("mb_count") / F.col("__total")).alias("merchant_frequency_ratio"),
        (cat_n / F.col("__total")).alias("category_frequency_ratio"),
        F.when(F.col("mb_count") <= 1, 1).otherwise(0).alias("is_new_merchant"),
        *_weekday_day(F.col("transaction_date")),
    ).drop("mb_count", "mb_mean", "mb_std", "cb_count", "cb_mean", "cb_std", "__total", "merchant_b")
