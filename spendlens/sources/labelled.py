"""Labelled training data.

CSV or Parquet in, typed DataFrame out; a table without the columns that the
models need is refused.  The history loader does not sort: order is carried as
an explicit key and used by the windows (W6), never as physical row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType

# fixed values: column names of the training files
TEXT_COLUMNS = ["description", "category"]
HISTORY_COLUMNS = ["user_id", "date", "merchant", "category", "amount", "is_injected_anomaly"]

HISTORY_TYPES: dict[str, DataType] = {"amount": DoubleType(), "is_injected_anomaly": IntegerType()}


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or an error that names every column it lacks."""
    lacking = sorted({*columns}.difference(df.columns))
    if lacking:
        raise ValueError(f"cannot train on this table, it lacks {lacking}")
    return df


def _table(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.options(header=True, multiLine=True)
    return reader.parquet(path) if path.endswith(".parquet") else reader.csv(path)


def load_labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """Texts with a category; rows that lack either are left out."""
    df = require_columns(_table(spark, path), TEXT_COLUMNS)
    return df.where(" and ".join(f"{c} is not null" for c in TEXT_COLUMNS))


def load_labelled_history(spark: SparkSession, path: str) -> DataFrame:
    """Typed history with ``transaction_date``; a file without
    ``transaction_id`` gets one from the row's content, as a tie-break."""
    raw = require_columns(_table(spark, path), HISTORY_COLUMNS)
    typed = raw.withColumns({c: F.col(c).cast(t) for c, t in HISTORY_TYPES.items()} |
                            {"transaction_date": F.to_timestamp("date").cast("timestamp_ntz")})
    if "transaction_id" in raw.columns:
        return typed
    return typed.withColumn("transaction_id", F.sha2(F.to_json(F.struct(*HISTORY_COLUMNS)), 256))
