"""Leak-free expanding-window features (W1-W3, W8, F2-F4) for all users at once.

For every transaction the baselines use only the same user's *earlier* rows:
order = (transaction_date, ingest tie-break), ROWS frame up to 1 preceding, so
an earlier row on the same date counts as prior.  The reference recomputes a
list scan per row (O(n^2) per user); here each key is one skew-safe running
aggregate (see ``running.prior_stats``): two row shuffles in total, one per
key (category, merchant), and no task ever holds a whole user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.scalar import (is_weekend, log_amount_pos, present, weekday_monday0,
                                        zscore)
from spendlens.operators.running import prior_stats_pair

FEATURE_NAMES = ["log_amount", "category_zscore", "merchant_zscore", "is_new_merchant",
                 "day_of_week", "is_weekend"]


def day_bucket(ts: str = "transaction_date") -> Column:
    """Default bucket for running aggregates: the calendar day (monotone in the order)."""
    return F.to_date(F.col(ts))


def expanding_features(txn: DataFrame, seq_col: str = "transaction_id",
                       user_col: str = "user_id", date_col: str = "transaction_date",
                       bucket: Column | None = None) -> DataFrame:
    """Adds the six model features plus the prior baselines used by explanations.

    Added columns: cat_n, cat_mean, cat_std, mer_n, mer_mean, mer_std and
    FEATURE_NAMES (all doubles).
    """
    bucket = bucket if bucket is not None else day_bucket(date_col)
    order = [date_col, seq_col]
    d = prior_stats_pair(txn, user_col, ("category", "merchant"), order, bucket, "amount",
                         ("cat", "mer"))
    has_merchant = present("merchant")
    # no merchant -> no merchant baseline (the reference skips falsy merchants)
    d = (d.withColumn("mer_n", F.when(has_merchant, F.col("mer_n")).otherwise(F.lit(0).cast("bigint")))
          .withColumn("mer_mean", F.when(has_merchant, F.col("mer_mean")))
          .withColumn("mer_std", F.when(has_merchant, F.col("mer_std")).otherwise(F.lit(0.0))))
    return (d
            .withColumn("log_amount", log_amount_pos("amount"))
            .withColumn("category_zscore", zscore("amount", "cat_mean", "cat_std"))
            .withColumn("merchant_zscore",
                        F.when(has_merchant, zscore("amount", "mer_mean", "mer_std"))
                         .otherwise(F.lit(0.0)))
            .withColumn("is_new_merchant",
                        F.when(has_merchant & (F.col("mer_n") == 0), F.lit(1.0)).otherwise(F.lit(0.0)))
            .withColumn("day_of_week", weekday_monday0(date_col).cast("double"))
            .withColumn("is_weekend", is_weekend(date_col)))
