"""SparkSession helpers.

The library never creates a session inside an operator: every function takes
DataFrames (or a session) in and returns DataFrames out. ``get_session`` is for
scripts, tests and the benchmark only. On a cluster the session comes from the
platform and already names ``spark.checkpoint.dir``; we read it, and only set
our own when it is unset (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins/partition counts at runtime
# and splits skewed join partitions (a user, file or term may hold a third of
# all rows); Arrow moves batches to the few pandas stages we have.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    # a join whose smaller side fits in memory partition by partition needs no sort
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # broadcast only what the planner can prove small; our explicit broadcasts
    # are parameter-bounded model tables, never data-sized frames
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # parsing projections generate methods above HotSpot's 8 KB JIT limit;
    # without this they would run interpreted (about 2-3x slower)
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "spendlens", driver_memory: str = "16g") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", driver_memory)
    builder = builder.config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Unset on a cluster is an error: executors would write to their own disks.
    A single-machine session (tests, benchmark) shares its local disk with all
    its tasks, so there, and only there, an unset folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="spendlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location for intermediate tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "spendlens", name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: lineage
    is cut, and later steps scan only the columns they use.  Zstandard, as most of
    these tables are ids and terms, which it makes about a quarter smaller."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession):
    """Steps written inside have their shuffle files removed at their end.

    Otherwise Spark removes them when the driver's garbage collector finds that nothing refers to them any more; a
    driver that has memory to spare may not collect before the executors' disks are full."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
