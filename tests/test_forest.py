from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from spendlens.operators import forest
from spendlens.plans import detect as det


def _history(spark):
    rng = np.random.default_rng(7)
    rows = []
    for u in range(4):
        for i in range(60):
            amt = float(rng.uniform(400, 440))
            if i in (55, 58) and u == 0:
                amt = 75000.0
            rows.append((f"u{u}-{i:03d}", u, datetime(2026, 1, 1) + timedelta(days=i), amt,
                         ["Food", "Bills"][i % 2], f"M{i % 3}"))
    return spark.createDataFrame(rows, "transaction_id string, user_id long, "
                                       "transaction_date timestamp_ntz, amount double, "
                                       "category string, merchant string")


def test_forest_is_partition_independent_and_finds_spike(spark):
    txn = _history(spark)
    feat = det.feature_table(txn)
    m1, s1 = forest.fit_forest(feat.repartition(1), det.FEATURE_NAMES, "transaction_id", n_trees=50)
    m2, s2 = forest.fit_forest(feat.repartition(7), det.FEATURE_NAMES, "transaction_id", n_trees=50)
    assert m1.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        m2.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    a = {r.transaction_id: r.score for r in s1.collect()}
    b = {r.transaction_id: r.score for r in s2.collect()}
    assert a == b
    assert all(-1.0 <= v <= 0.0 for v in a.values())
    det_rows = {r.transaction_id: r for r in det.detect(feat, m1).collect()}
    spike = det_rows["u0-055"]
    assert spike.is_anomaly and spike.anomaly_score > 0.9 and spike.severity == "high"
    assert spike.reason_code is not None and spike.reason is not None
    normal_scores = [r.anomaly_score for k, r in det_rows.items() if k.startswith("u0") and k not in
                     ("u0-055", "u0-058")]
    assert spike.anomaly_score > max(normal_scores)
    assert all(0.0 <= r.anomaly_score <= 1.0 for r in det_rows.values())
    flagged = sum(r.is_anomaly for r in det_rows.values()) / len(det_rows)
    assert 0.02 <= flagged <= 0.10


def test_insufficient_history_and_not_ready(spark):
    txn = _history(spark).where("transaction_id < 'u0-005' or user_id = 1")
    feat = det.feature_table(txn)
    model, _ = det.train_detector(feat)
    s = {r.user_id: r for r in det.scan_summary(txn, det.detect(feat, model)).collect()}
    assert s[0].status == "insufficient_data" and s[0].anomalies_found == 0
    assert s[0].message == "Need at least 10 transactions for anomaly detection; you have 5."
    assert s[1].status == "completed" and s[1].message.startswith("Scanned 60 transactions, found ")
    assert det.detect(feat, None).count() == 0
    nr = {r.user_id: r.status for r in det.scan_summary(txn, None, model_ready=False).collect()}
    assert nr[1] == "model_not_ready"


def test_path_length_constants():
    assert forest.avg_path_length(1) == 0.0 and forest.avg_path_length(2) == 1.0
    assert abs(forest.avg_path_length(256) - 10.244770920116851) < 1e-9


def test_detection_shuffles_no_features(spark):
    from spendlens.operators.expanding import FEATURE_NAMES
    rows = [(f"t{u}-{i}", u, 10.0 + i, "food", f"m{i % 3}", i, 5.0, i, 6.0, *[float(i)] * len(FEATURE_NAMES), 0.5 - (i == 11)) for u in (1, 2) for i in range(12)]
    names = ["transaction_id", "user_id", "amount", "category", "merchant", "cat_n", "cat_mean", "mer_n", "mer_mean", *FEATURE_NAMES, "score"]
    scored = det.stored(spark.createDataFrame(rows, names), "scored")
    out = det.detect(scored, forest.ForestModel(FEATURE_NAMES, [0.0] * 6, [1.0] * 6, None, 8), scored=scored)
    assert sorted((r.transaction_id, r.reason_code is not None, r.anomaly_score) for r in out.collect()) == sorted(
        (f"t{u}-{i}", i == 11, float(i == 11)) for u in (1, 2) for i in range(12))
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    columns = node.children().head().output().mkString(",")   # of the rows that meet their users' statistics
    assert "decision" in columns and "cat_mean" not in columns and "merchant" not in columns
