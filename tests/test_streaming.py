import math
import os

from pyspark.sql import functions as F

from spendlens.operators.expanding import expanding_features
from spendlens.plans.importer import Store
from spendlens.sources import views
from spendlens.streaming.baselines import incremental_features
from spendlens.streaming.ingest import start_folder_ingest


def test_stream_baselines_equal_batch(spark, sf, tmpdir_path):
    ev = views.txn_events(spark, sf)
    src = os.path.join(tmpdir_path, "events")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (incremental_features(stream).writeStream.format("memory").queryName("t2_out")
         .outputMode("append").option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.event_id: r for r in spark.table("t2_out").collect()}
    batch = expanding_features(ev.withColumnRenamed("ts", "transaction_date"),
                               seq_col="event_id").collect()
    assert len(got) == len(batch)
    for b in batch:
        s = got[b.event_id]
        assert math.isclose(s.category_zscore, b.category_zscore, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(s.merchant_zscore, b.merchant_zscore, rel_tol=1e-9, abs_tol=1e-9)
        assert s.is_new_merchant == b.is_new_merchant and not s.late


def test_folder_ingest_stream_is_idempotent(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in", "user_id=u7")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("date,description,amount\n2026-01-05,A,-10\n2026-01-06,B,20\n")
    store = Store(os.path.join(tmpdir_path, "store"))
    for run in range(2):   # the second run has a fresh checkpoint: a full replay
        q = start_folder_ingest(spark, os.path.join(tmpdir_path, "in"), store,
                                os.path.join(tmpdir_path, f"ck{run}"), partition_schema="user_id string")
        q.awaitTermination()
    t = spark.read.parquet(store.path("transactions"))
    assert t.count() == 2 and t.select("user_id").distinct().first()[0] == "u7"
