"""Expanding features: goldens, brute force on real data, bucket invariance."""

import math
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from spendlens.operators.expanding import expanding_features
from spendlens.operators.running import prior_stats, running_prior_max, running_row_number
from spendlens.sources import views

SCHEMA = ("transaction_id string, user_id long, transaction_date timestamp_ntz, amount double, "
          "category string, merchant string")


def test_goldens(spark):
    rows = [("t%02d" % i, 1, datetime(2026, 1, 5), 100.0 + i, "Food", "M1") for i in range(11)]
    rows += [("t99", 1, datetime(2026, 1, 10), 5000.0, "Food", "M1"),     # Saturday spike
             ("t98", 1, datetime(2026, 1, 10), 50.0, "Food", "NEW"),
             ("t97", 1, datetime(2026, 1, 10), 50.0, "Food", None)]
    f = {r.transaction_id: r for r in expanding_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    first = f["t00"]
    assert (first.category_zscore, first.merchant_zscore, first.is_new_merchant) == (0.0, 0.0, 1.0)
    assert first.day_of_week == 0.0 and first.is_weekend == 0.0          # Monday
    assert f["t01"].is_new_merchant == 0.0 and f["t01"].category_zscore == 0.0   # one prior: std 0
    assert f["t99"].category_zscore > 5 and f["t99"].is_weekend == 1.0 and f["t99"].day_of_week == 5.0
    assert f["t98"].is_new_merchant == 1.0
    assert f["t97"].is_new_merchant == 0.0 and f["t97"].merchant_zscore == 0.0
    assert math.isclose(f["t99"].log_amount, math.log1p(5000.0))


def _brute(rows):
    """O(n^2) plain-Python features from each row's prior list (the reference's definition)."""
    by_user = defaultdict(list)
    for r in rows:
        by_user[r.user_id].append(r)
    out = {}
    for hist in by_user.values():
        hist.sort(key=lambda r: (r.transaction_date, r.transaction_id))
        for i, r in enumerate(hist):
            prior = hist[:i]

            def ms(vals):
                if not vals:
                    return 0.0, 0.0
                m = sum(vals) / len(vals)
                if len(vals) < 2:
                    return m, 0.0
                return m, math.sqrt(sum((v - m) ** 2 for v in vals) / (len(vals) - 1))
            cm, cs = ms([p.amount for p in prior if p.category == r.category])
            mm, msd = ms([p.amount for p in prior if r.merchant and p.merchant == r.merchant])
            known = {p.merchant for p in prior if p.merchant}
            out[r.transaction_id] = ((r.amount - cm) / cs if cs > 0 else 0.0,
                                     (r.amount - mm) / msd if msd > 0 else 0.0,
                                     1.0 if (r.merchant and r.merchant not in known) else 0.0)
    return out


def test_matches_brute_force_on_sf0001(spark, sf):
    txn = views.txn_star(spark, sf)
    rows = txn.collect()
    expect = _brute(rows)
    got = expanding_features(txn).select("transaction_id", "category_zscore", "merchant_zscore",
                                         "is_new_merchant").collect()
    assert len(got) == len(expect)
    for r in got:
        e = expect[r.transaction_id]
        assert math.isclose(r.category_zscore, e[0], rel_tol=1e-9, abs_tol=1e-9), r
        assert math.isclose(r.merchant_zscore, e[1], rel_tol=1e-9, abs_tol=1e-9), r
        assert r.is_new_merchant == e[2]


def test_bucketing_does_not_change_results(spark, sf):
    """One hot group split into many buckets == one bucket (the plain window)."""
    t = views.txn_star(spark, sf).withColumn("g", F.lit("all"))
    order = ["transaction_date", "transaction_id"]
    fine = prior_stats(t, ["g"], order, F.to_date("transaction_date"), "amount", "p")
    single = prior_stats(t, ["g"], order, F.lit(0), "amount", "p")
    a = {r.transaction_id: (r.p_n, r.p_mean, r.p_std) for r in fine.collect()}
    b = {r.transaction_id: (r.p_n, r.p_mean, r.p_std) for r in single.collect()}
    for k, (n, m, s) in a.items():
        n2, m2, s2 = b[k]
        assert n == n2
        assert (m is None and m2 is None) or math.isclose(m, m2, rel_tol=1e-9)
        assert math.isclose(s, s2, rel_tol=1e-8, abs_tol=1e-6)
    rn = running_row_number(t, ["g"], order, F.to_date("transaction_date"), "rn")
    assert sorted(r.rn for r in rn.collect()) == list(range(1, t.count() + 1))
    mx = running_prior_max(t, ["g"], order, F.to_date("transaction_date"), F.col("amount"), "mx")
    ordered = sorted(mx.collect(), key=lambda r: (r.transaction_date, r.transaction_id))
    best = None
    for r in ordered:
        assert r.mx == best
        best = r.amount if best is None else max(best, r.amount)


def test_constant_series_has_zero_std(spark):
    rows = [("t%02d" % i, 1, datetime(2026, 1, 1 + i), 0.1, "C", "M") for i in range(20)]
    f = expanding_features(spark.createDataFrame(rows, SCHEMA))
    assert f.where("cat_std != 0 or category_zscore != 0").count() == 0
