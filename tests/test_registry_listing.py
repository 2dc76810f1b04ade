import os

import pytest
from pyspark.sql import functions as F

from spendlens.operators import listing as lst
from spendlens.operators import registry as reg


def test_promotions_running_max(spark):
    scores = [0.5, 0.3, 0.5, None, 0.7, 0.6]
    h = spark.createDataFrame([("m", i + 1, s) for i, s in enumerate(scores)],
                              "model_name string, version long, score double")
    got = [r.promoted for r in reg.promotions(h).orderBy("version").collect()]
    assert got == [True, False, True, False, True, False]
    st = reg.model_status(h).first()
    assert (st.active_version, st.latest_version, st.next_version, st.is_ready) == (5, 6, 7, True)


def test_artifacts_save_promote_load(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "models")
    assert reg.load_active(spark, base, "anomaly-detector", ["nodes"]) == (None, None)
    assert reg.next_version(spark, base, "anomaly-detector") == 1
    t = spark.createDataFrame([(1, 2.0)], "a int, b double")
    reg.save_version(spark, base, "anomaly-detector", 1, {"nodes": t}, {"f1": 0.4}, {"n_trees": 200})
    assert reg.maybe_promote(spark, base, "anomaly-detector", 1, {"f1": 0.4})
    reg.save_version(spark, base, "anomaly-detector", 2, {"nodes": t}, {"f1": 0.3}, {})
    assert not reg.maybe_promote(spark, base, "anomaly-detector", 2, {"f1": 0.3})
    assert reg.next_version(spark, base, "anomaly-detector") == 3
    tables, meta = reg.load_active(spark, base, "anomaly-detector", ["nodes"])
    assert meta["version"] == 1 and tables["nodes"].count() == 1
    reg.log_runs(spark, base, [("r1", "isolation_forest", 10, 42, "f1", 0.4)])
    assert spark.read.parquet(os.path.join(base, "_runs")).count() == 1


def test_listing_validation_and_pages(spark):
    with pytest.raises(ValueError):
        lst.validate_page("transactions", -1, 10)
    with pytest.raises(ValueError):
        lst.validate_page("imports", 0, 101)
    with pytest.raises(ValueError):
        lst.validate_choice("CRITICAL", lst.SEVERITIES, "severity")
    df = spark.createDataFrame([(u, i) for u in ("a", "b") for i in range(7)], "u string, i int")
    p = lst.page(df, "u", [F.col("i").desc()], skip=2, limit=3).collect()
    assert sorted((r.u, r.i, r.position, r.total) for r in p) == [
        ("a", 2, 5, 7), ("a", 3, 4, 7), ("a", 4, 3, 7), ("b", 2, 5, 7), ("b", 3, 4, 7), ("b", 4, 3, 7)]
    req = spark.createDataFrame([(1, "a"), (2, "zz")], "i int, u string")
    assert {(r.u, r.i) for r in lst.lookup_owned(df, req, "i", "u").collect()} == {("a", 1)}
    cats = spark.createDataFrame([("Food", None, True)], "name string, user_id string, is_system boolean")
    defaults = spark.createDataFrame([(c, None, True) for c in lst.DEFAULT_CATEGORIES],
                                     "name string, user_id string, is_system boolean")
    assert lst.insert_if_absent(cats, defaults, ["name", "user_id"]).count() == 17


def test_a_page_of_anomalies_scores_once_and_makes_whole_records_last(spark, sf):
    from spendlens.plans import catalog
    out = catalog.q_anomalies_page(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "decision" not in plan and "amount#" not in plan   # scored and joined in the stored table
    rows = out.collect()
    assert rows and all(r.severity == "high" and r.reason == "amount" and len(r.anomaly_id) == 64 and r.created_at for r in rows)
    assert out.columns[:2] == ["user_id", "anomaly_id"] and out.columns[-2:] == ["position", "total"]
