"""Binary detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.scalar import safe_ratio


def binary_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 (0 on zero division), flagged and injected rates.

    One global aggregate; ``truth`` and ``pred`` are 0/1 (or boolean) columns.
    """
    t = F.col(truth).cast("int") == 1
    p = F.col(pred).cast("int") == 1
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
               F.count_if(t & ~p).alias("fn"), F.count_if(p).alias("flagged"),
               F.count_if(t).alias("injected"), F.count(F.lit(1)).alias("n"))
    prec = safe_ratio("tp", F.col("tp") + F.col("fp"))
    rec = safe_ratio("tp", F.col("tp") + F.col("fn"))
    f1 = safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select(prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    safe_ratio("flagged", "n").alias("flagged_rate"),
                    safe_ratio("injected", "n").alias("injected_rate"))
