"""Model registry on a shared folder.

Layout under ``base``: ``<model>/<version>/<table>`` Parquet tables (the
forest node table, naive-Bayes term tables, ...), ``<model>/<version>/_meta``
(one metadata row) and ``<model>/_active`` (the active version).  Promotion
over a whole history of versions is a running maximum (W7): a version is
promoted iff its metric is >= the active one, so the active metric is always
the best metric seen so far.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (LongType, MapType, StringType, StructField, StructType,
                               DoubleType, TimestampType)

from spendlens.operators.running import running_prior_max

NEG_INF = float("-inf")
# fixed values: the promotion metric of each model family in the reference
METRIC_KEY = {"transaction-classifier": "macro_f1", "anomaly-detector": "f1"}
VERSION_BUCKET = 4096

META_SCHEMA = StructType([
    StructField("model_name", StringType()), StructField("version", LongType()),
    StructField("metrics", MapType(StringType(), DoubleType())),
    StructField("params", MapType(StringType(), StringType())),
    StructField("created_at", TimestampType())])


# ---------------------------------------------------------------- relational

def promotions(history: DataFrame, model_col: str = "model_name", version_col: str = "version",
               score_col: str = "score") -> DataFrame:
    """``promoted`` for every version (missing score = -inf; the first
    version always wins; ties promote).  Skew-safe running max per model."""
    s = F.coalesce(F.col(score_col), F.lit(NEG_INF))
    h = running_prior_max(history, [model_col], [version_col],
                          F.floor(F.col(version_col) / F.lit(VERSION_BUCKET)), s, "__best_before")
    return (h.withColumn("promoted", s >= F.coalesce(F.col("__best_before"), F.lit(NEG_INF)))
             .drop("__best_before"))


def model_status(history: DataFrame, model_col: str = "model_name",
                 version_col: str = "version", score_col: str = "score") -> DataFrame:
    """M16 + A11: per model -- ready flag, active version, latest and next version."""
    p = promotions(history, model_col, version_col, score_col)
    return (p.groupBy(model_col)
             .agg(F.max(F.when(F.col("promoted"), F.col(version_col))).alias("active_version"),
                  F.max(version_col).alias("latest_version"),
                  F.count(F.lit(1)).alias("versions"))
             .withColumn("is_ready", F.col("active_version").isNotNull())
             .withColumn("next_version", F.coalesce(F.col("latest_version"), F.lit(0)) + 1))


# ---------------------------------------------------------------- artifacts

def _dir(base: str, model: str, version: int | None = None) -> str:
    return os.path.join(base, model) if version is None else os.path.join(base, model, str(version))


def table_path(base: str, model: str, version: int, name: str) -> str:
    """Where a version's artefact of that name lies."""
    return os.path.join(_dir(base, model, version), name)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any path fits the pattern.  Only absence is an answer: a folder
    that cannot be read raises."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def list_versions(spark: SparkSession, base: str, model: str) -> DataFrame:
    """The metadata rows of all versions; empty only when none was ever saved."""
    path = os.path.join(_dir(base, model), "*", "_meta")
    if not exists(spark, path):
        return spark.createDataFrame([], META_SCHEMA)
    return spark.read.schema(META_SCHEMA).parquet(path)


def next_version(spark: SparkSession, base: str, model: str) -> int:
    """Max existing version + 1 (1 when none)."""
    v = list_versions(spark, base, model).agg(F.max("version")).first()[0]
    return int(v or 0) + 1


def save_version(spark: SparkSession, base: str, model: str, version: int,
                 tables: dict[str, DataFrame], metrics: dict[str, float],
                 params: dict[str, object]) -> str:
    """Write each model table as Parquet plus one metadata row."""
    d = _dir(base, model, version)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(d, name))
    meta = spark.createDataFrame(
        [(model, int(version), {k: float(v) for k, v in metrics.items()},
          {k: v if isinstance(v, str) else json.dumps(v) for k, v in params.items()},
          datetime.now(UTC).replace(tzinfo=None))], META_SCHEMA)
    meta.coalesce(1).write.mode("overwrite").parquet(os.path.join(d, "_meta"))
    return d


def active_version(spark: SparkSession, base: str, model: str) -> int | None:
    path = os.path.join(_dir(base, model), "_active")
    if not exists(spark, path):
        return None
    row = spark.read.parquet(path).first()
    return int(row[0]) if row else None


def maybe_promote(spark: SparkSession, base: str, model: str, version: int,
                  metrics: dict[str, float], metric_key: str | None = None) -> bool:
    """Promote ``version`` iff its metric >= the active version's (or none active)."""
    key = metric_key or METRIC_KEY.get(model, "macro_f1")
    current = active_version(spark, base, model)
    if current is not None:
        meta = list_versions(spark, base, model).where(F.col("version") == current).first()
        cur = (meta["metrics"] or {}).get(key, NEG_INF) if meta else NEG_INF
        cur = NEG_INF if cur is None else cur
        new = metrics.get(key, NEG_INF)
        if not (new if new is not None else NEG_INF) >= cur:
            return False
    spark.createDataFrame([(int(version),)], "version bigint").coalesce(1).write.mode(
        "overwrite").parquet(os.path.join(_dir(base, model), "_active"))
    return True


def load_active(spark: SparkSession, base: str, model: str, names: list[str]):
    """M9: (tables, metadata) of the active version, or (None, None) when no
    version is active or an artifact is missing."""
    v = active_version(spark, base, model)
    if v is None or not all(exists(spark, table_path(base, model, v, n)) for n in names):
        return None, None
    meta = list_versions(spark, base, model).where(F.col("version") == v).first()
    return {n: spark.read.parquet(table_path(base, model, v, n)) for n in names}, (meta.asDict() if meta else None)


def log_runs(spark: SparkSession, base: str, rows: list[tuple]) -> None:
    """Append (run, model_type, dataset_rows, seed, metric, value) rows."""
    df = spark.createDataFrame(rows, "run string, model_type string, dataset_rows bigint, "
                                     "seed bigint, metric string, value double")
    df.write.mode("append").parquet(os.path.join(base, "_runs"))
