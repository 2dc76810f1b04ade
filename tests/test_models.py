import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spendlens.operators import forest, registry
from spendlens.operators import textclass as tc
from spendlens.operators.expanding import FEATURE_NAMES
from spendlens.plans import detect as det
from spendlens.operators.explain import with_reasons
from spendlens.plans import train
from spendlens.sources.labelled import load_labelled_history, load_labelled_text
from spendlens.sources import views


def test_reason_texts_and_all_reasons(spark):
    row = dict(is_new_merchant=0.0, category_zscore=3.0, cat_n=5, cat_mean=400.0, merchant="Shop",
               merchant_zscore=4.0, mer_n=3, mer_mean=410.0, is_weekend=1.0, amount=1250.0,
               category="Food")
    df = spark.createDataFrame([row])
    r = with_reasons(df).first()
    assert r.reason_code == "category_spike" and r.reasons == ["category_spike", "merchant_spike", "weekend"]
    assert r.reason == ("Amount is 3.1x higher than your usual spending in the 'Food' category "
                        "(your typical amount is about 400).")
    m = with_reasons(df.withColumn("cat_mean", F.lit(-1.0))).first()
    assert m.reason == "Your typical transaction amount for Shop is about 410; this transaction is 1250."
    g = with_reasons(df.withColumn("category_zscore", F.lit(0.0)).withColumn("merchant_zscore", F.lit(0.0))
                     .withColumn("is_weekend", F.lit(0.0))).first()
    assert g.reason_code == "generic" and g.reasons == ["generic"]
    flagged_off = with_reasons(df, only_when=F.lit(False)).first()
    assert flagged_off.reason is None


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    means, scales = forest.fit_scaler(df, ["a", "b"])
    assert means == [2.0, 5.0] and scales == [1.0, 1.0]      # ddof 0; zero std -> 1
    z = forest.standardize(df, ["a", "b"], means, scales).select("__z_a").collect()
    assert sorted(r[0] for r in z) == [-1.0, 1.0]


def test_train_promote_evaluate_categorizer(spark, sf, tmpdir_path):
    base = os.path.join(tmpdir_path, "models")
    assert train.load_categorizer(spark, base) is None          # not ready -> fallback
    assert [r.is_ready for r in train.models_status(spark, base).collect()] == [False, False]
    docs = views.labelled_text(spark, sf)
    r1 = train.train_categorizer(spark, docs, base)
    assert r1["version"] == 1 and r1["promoted"] and r1["model_type"] in train.CANDIDATES
    runs = spark.read.parquet(os.path.join(base, "_runs"))
    assert {r.model_type for r in runs.collect()} == set(train.CANDIDATES)
    m = train.evaluate_categorizer(spark, base, docs)
    assert 0.5 <= m["macro_f1"] <= 1.0
    assert {"accuracy", "macro avg", "weighted avg"} <= {r.label for r in m["report"].collect()}
    status = {r.model_name: r for r in train.models_status(spark, base).collect()}
    assert status[train.CLASSIFIER].is_ready and status[train.CLASSIFIER].active_version == 1
    with pytest.raises(ValueError):
        train.evaluate_categorizer(spark, base, docs, version=9)


def test_every_kind_of_classifier_survives_a_reload(spark, sf, tmpdir_path):
    base = os.path.join(tmpdir_path, "models")
    docs = views.labelled_text(spark, sf)
    prepared = tc.prepare(docs).select("id", "terms")
    for n, candidate in enumerate(train.fit_candidates(spark, docs), start=1):
        assert train.save_categorizer(spark, base, candidate) == n
        again = train.read_categorizer(spark, base, n)
        assert again.kind == candidate.model.kind
        before = {r.id: (r.predicted, round(r.confidence, 9)) for r in candidate.model.predict(prepared).collect()}
        after = {r.id: (r.predicted, round(r.confidence, 9)) for r in again.predict(prepared).collect()}
        assert before == after and len(after) == docs.count()


def test_detector_survives_a_reload(spark, sf, tmpdir_path):
    base = os.path.join(tmpdir_path, "models")
    txn = views.txn_star(spark, sf)
    r = train.train_anomaly_detector(spark, txn, base)
    model = train.load_detector(spark, base)
    assert model.features == FEATURE_NAMES
    feat = det.feature_table(txn, extra=["is_injected_anomaly"])
    again = forest.decision(model, feat)
    fresh, scored = det.train_detector(feat)
    a = {x.transaction_id: round(x.decision, 9) for x in again.select("transaction_id", "decision").collect()}
    b = {x.transaction_id: round(x.decision, 9) for x in scored.select("transaction_id", "decision").collect()}
    assert a == b
    assert train.evaluate_detector(spark, base, txn) == pytest.approx(r["metrics"])


def test_an_unreadable_registry_is_no_empty_one(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "models")
    os.makedirs(os.path.join(base, train.CLASSIFIER, "1", "_meta"))
    with open(os.path.join(base, train.CLASSIFIER, "1", "_meta", "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        registry.next_version(spark, base, train.CLASSIFIER)


def test_labelled_loaders(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as f:
        f.write("description,category\nSWIGGY,Food\n,Food\nUBER,\n")
    assert load_labelled_text(spark, p).count() == 1
    h = os.path.join(tmpdir_path, "h.csv")
    with open(h, "w") as f:
        f.write("user_id,date,category,amount\n1,2026-01-05,Food,10\n")
    with pytest.raises(ValueError, match=r"\['is_injected_anomaly', 'merchant'\]"):
        load_labelled_history(spark, h)
