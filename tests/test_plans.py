"""Plan-shape guards for the scale design (read from the physical plan)."""

import re

from pyspark.sql import functions as F

from spendlens.operators.expanding import expanding_features
from spendlens.operators.statement import import_summary
from spendlens.plans.detect import per_user_scale
from spendlens.sources import views


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _window_partitions(plan: str) -> list[list[str]]:
    out = []
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[", plan):
        out.append([c.strip() for c in m.group(1).split(",") if c.strip()])
    return out


def test_expanding_features_never_window_a_whole_user(spark, sf):
    plan = _plan(expanding_features(views.txn_star(spark, sf)))
    assert "Expand" in plan                      # both keys' bucket tables in one aggregate
    parts = _window_partitions(plan)
    assert parts, plan
    for p in parts:                              # (user, key[, bucket]) -- never the user alone
        assert len(p) >= 4, p


def test_group_stats_are_aggregates_not_user_windows(spark, sf):
    t = views.txn_star(spark, sf).select("transaction_id", "user_id", F.col("amount").alias("decision"))
    plan = _plan(per_user_scale(t))
    assert "HashAggregate" in plan and not _window_partitions(plan)


def test_first_errors_are_limited_before_the_shuffle(spark):
    rows = spark.createDataFrame([("u", "f", i, "bad" if i % 2 else None) for i in range(200)],
                                 "user_id string, file_id string, row_num int, error string")
    plan = _plan(import_summary(rows, ["user_id", "file_id"]))
    assert "WindowGroupLimit" in plan


def test_a_hot_key_is_dealt_over_many_join_partitions(spark):
    """A user with a third of all rows, broadcast and adaptive execution off:
    the largest partition of the joined rows stays far below the hot user's size."""
    from spendlens.operators.joinback import join_back
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                           "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        rows = spark.range(60000).selectExpr("id", "if(id % 3 = 0, 0, id) as user_id", "cast(id as double) as v")
        stats = rows.groupBy("user_id").agg(F.count("*").alias("n"))
        out = join_back(rows, stats, ["user_id"])
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        hot = out.where("user_id = 0").agg(F.max("n"), F.count("*")).first()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert tuple(hot) == (20000, 20000) and sum(sizes) == 60000
    assert max(sizes) < 10000, sizes


def test_rows_without_a_key_keep_their_group(spark):
    from spendlens.operators.joinback import join_back
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id int, user_id string")
    stats = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    assert {r.id: r.n for r in join_back(rows, stats, ["user_id"], null_safe=True).collect()} == {1: 1, 2: 2, 3: 2}
    assert {r.id: r.n for r in join_back(rows, stats, ["user_id"]).collect()} == {1: 1, 2: None, 3: None}


def test_only_hot_keys_are_repeated(spark):
    """Salts by measured skew: as many statistics as keys and fewer than two more a
    partition; a user with a third of all rows and rows without a user are both split."""
    from spendlens.operators import joinback
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                           "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        rows = spark.range(60000).selectExpr("id", "case id % 6 when 0 then 0 when 1 then 0 when 2 then null else id end as user_id")
        stats = rows.groupBy("user_id").agg(F.count("*").alias("n"))
        hot = joinback.hot_keys(stats, ["user_id"], "n", 1000)
        assert sorted(r["__salts"] for r in hot.collect()) == [3, 6]  # 10,000 and 20,000 rows, 3,750 a partition
        assert joinback.repeated(stats, hot, ["user_id"]).count() == stats.count() + 2 + 5 < stats.count() + 2 * 16
        for null_safe in (False, True):
            out = joinback.join_back(rows, stats, ["user_id"], null_safe=null_safe, count="n", floor=1000)
            sizes = [r[1] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            got = {r.user_id: (r.n, r.rows) for r in out.where("user_id is null or user_id = 0")
                   .groupBy("user_id", "n").agg(F.count("*").alias("rows")).collect()}
            assert got == {0: (20000, 20000), None: (10000 if null_safe else None, 10000)}
            assert sum(sizes) == 60000 and max(sizes) < 20000, sizes
            assert out.where("user_id > 0 and n <> 1").count() == 0
        assert joinback.hot_keys(stats, ["user_id"], "n").count() == 0  # below the floor nothing is split
        assert "Expand" not in _plan(joinback.join_back(rows, stats, ["user_id"], count="n"))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
