"""Shuffle files of a step that is stored do not stay on the disks until the driver happens to collect its garbage."""

import time
from pathlib import Path

from spendlens.session import stored


def _shuffles(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in blocks for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = _shuffles(spark)
    out = stored(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts")
    end = time.time() + 20
    while _shuffles(spark) - before and time.time() < end:   # removed in the background
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    assert out.count() == 7
