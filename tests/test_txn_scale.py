"""Histories of users that fit one task are dealt once; those of hot users are cut, with the same results."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.operators import expanding, forest, history, joinback, running
from spendlens.session import stored


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    """A user with half of all rows, small users and rows without one; keys may be null, amounts constant."""
    return stored(spark.range(600).selectExpr(
        "concat('t', lpad(id, 4, '0')) as transaction_id", "case when id % 2 = 0 then 1 when id % 10 in (1, 3) then null else id % 9 + 2 end as user_id",
        "timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(int(id * 7 % 40)) as transaction_date", "if(id % 6 = 0, 0.1, double(id * 37 % 101)) as amount",
        "if(id % 11 = 0, null, concat('c', id % 6)) as category", "if(id % 7 = 0, null, concat('m', id % 5)) as merchant", "concat('d', id % 4) as description"), "rows")


def _same(a, b):
    a, b = ({r.transaction_id: r.asDict() for r in d.collect()} for d in (a, b))
    assert len(a) == 600 and a.keys() == b.keys()
    for k, r in a.items():
        for c, v in r.items():
            w = b[k][c]
            assert v == w or math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9), (k, c, v, w)


def test_a_hot_user_gives_the_same_prior_statistics(spark):
    rows, args = _rows(spark), ("user_id", ("category", "merchant"), ["transaction_date", "transaction_id"], expanding.day_bucket(), "amount", ("cat", "mer"))
    usual, hot = joinback.split_hot(rows, "user_id", 40)
    assert hot.count() == 300 + 120 and usual.count() == 180
    by_user = running.prior_stats_pair(rows, *args)
    _same(running.prior_stats_pair(rows, *args, floor=40), by_user)
    _same(running._pair_by_bucket(rows, *args), by_user)


def test_both_keys_of_usual_users_share_one_exchange(spark):
    rows = _rows(spark)
    plan = _plan(running._pair_by_user(rows, "user_id", ("category", "merchant"), ["transaction_date"], expanding.day_bucket(), "amount", ("cat", "mer")))
    assert len(re.findall(r"Exchange", plan)) == 1


@pytest.mark.parametrize("total", [None, "n"])
def test_a_hot_user_gives_the_same_history_statistics(spark, total):
    rows = _rows(spark)
    keys = {"m": "merchant", "c": "category"}
    _same(history.both_stats(rows, "user_id", keys, total, floor=40), history.both_stats(rows, "user_id", keys, total))
    none = history.both_stats(rows, "user_id", keys, total).where("user_id is null").agg(F.count("m_count"), F.count("c_std")).first()
    assert tuple(none) == (0, 0)


def test_statistics_are_aggregated_once(spark):
    rows = _rows(spark)
    stats = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    assert "sum(amount" not in _plan(joinback.join_back(rows, stats, ["user_id"], null_safe=True, count="n"))


def test_paths_of_columns_equal_a_walk_row_by_row():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(5000, 3))
    X[::50, 1] = np.nan
    nodes = pd.concat([forest._grow(pd.DataFrame(rng.normal(size=(64, 3)), columns=list("abc")).assign(tree=t, __h=range(64)), list("abc"), 1, 6)
                       for t in range(5)])
    got = forest._path_scores(list(X.T), forest._flat(nodes), 2.0)
    trees = [list(g.itertuples()) for _, g in nodes.groupby("tree")]
    for i in range(0, 5000, 37):
        lengths = []
        for tree in trees:
            n = tree[0]
            while n.feature >= 0:
                n = tree[n.left if X[i, n.feature] <= n.threshold else n.right]
            lengths.append(n.depth + forest.avg_path_length(n.size))
        assert math.isclose(got[i], -2.0 ** (-np.mean(lengths) / 2.0), rel_tol=1e-12)


def test_rows_without_a_date_count_as_prior_rows_only(spark):
    rows = stored(_rows(spark).withColumn("transaction_date", F.when(F.col("transaction_id") > "t0009", F.col("transaction_date"))), "rows")
    args = ("user_id", ("category", "merchant"), ["transaction_date", "transaction_id"], expanding.day_bucket(), "amount", ("cat", "mer"))
    a, b = ({r.transaction_id: (r.cat_n, r.mer_n) for r in d.collect()} for d in (
        running.prior_stats_pair(rows, *args), running._pair_by_bucket(rows, *args)))
    assert a == b and len(a) == 590


def test_tasks_of_windows_follow_the_rows(spark, monkeypatch):
    rows = _rows(spark)
    assert joinback.dealt(rows, rows, "user_id").rdd.getNumPartitions() == 8
    monkeypatch.setattr(joinback, "TASK_ROWS", 20)
    assert joinback.dealt(rows.where("user_id = 1"), rows, "user_id").rdd.getNumPartitions() == 30
    plan = _plan(history.both_stats(rows, "user_id", {"m": "merchant", "c": "category"}))
    assert re.search(r"Exchange hashpartitioning\(user_id#\d+L?, 30\)", plan), plan


def test_descriptions_are_stored_only_where_they_are_read(spark, sf, monkeypatch):
    from spendlens.plans import catalog
    kept = []
    monkeypatch.setattr(catalog, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    out = catalog.q_history_features_a(spark, sf)
    found = kept[0].agg(F.count_if(F.expr("description is not null and merchant is not null")), F.count_if(F.expr("description is not null"))).first()
    assert found[0] == 0 < found[1]
    assert out.where("merchant_key is null").isEmpty()
