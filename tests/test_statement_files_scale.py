"""Small statement files are written by all tasks and read by few."""

import re
from pathlib import Path

from spendlens.sources import views
from spendlens.sources.statements import split_records


def test_many_small_statements_are_written_by_many_tasks(spark, tmp_path):
    raw = spark.range(24).selectExpr(
        "id as user_id", "id as row_key", "1 as layout", "'2024-01-02' as date_raw", "'shop' as desc_raw", "'5' as amt_raw", "'' as type_raw", "'' as merchant_raw")
    tasks = views.write_raw_statement_files(raw, str(tmp_path / "s"))
    files = list(Path(tmp_path / "s").rglob("part-*.csv"))
    assert len(files) == 24
    writers = {re.match(r"part-(\d+)", f.name)[1] for f in files}
    assert len(writers) > 1 or spark.sparkContext.defaultParallelism == 1
    assert tasks >= spark.sparkContext.defaultParallelism
    rows = spark.read.option("header", True).csv(str(tmp_path / "s" / "layout=1")).where("debit is not null or credit is not null")
    assert {r.user_id for r in rows.select("user_id").collect()} == set(range(24))


def test_tasks_write_cells_as_they_are_and_few_tasks_list_the_files(spark, tmp_path):
    cells = ["plain", " a, b ", 'say "hi", x', "two\nlines", "₹5,000.50", "", None]
    users = [1, 1, None, 2, 2, 2, 3]
    raw = spark.createDataFrame(list(zip(users, range(7), cells, strict=True)), "user_id long, row_key long, desc_raw string").selectExpr(
        "user_id", "row_key", "3 as layout", "'2024-01-02' as date_raw", "desc_raw", "'5' as amt_raw", "cast(null as string) as type_raw", "' M1' as merchant_raw")
    folder = tmp_path / "s"
    for _ in range(2):   # the second time over the first
        tasks = views.write_raw_statement_files(raw, str(folder))
    left = [f for f in folder.rglob("*") if f.is_file()]
    assert len(left) == 4 and all(re.fullmatch(r"part-\d+\.csv", f.name) for f in left)   # no checksum files, no drafts
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None)
    files = views.read_statement_files(spark, str(folder), tasks)
    assert files.rdd.getNumPartitions() <= tasks
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) == before
    recs = split_records(files.select("path", "content", "user_id", "rows_before")).collect()
    assert {(r.user_id, r.row_num, r.raw["description"]) for r in recs} == {
        (1, 2, "plain"), (1, 3, " a, b "), (None, 2, 'say "hi", x'), (2, 2, "two\nlines"), (2, 3, "₹5,000.50"), (2, 4, ""), (3, 2, "")}
    assert all(r.header == ["date", "description", "amount", "type", "merchant"] and r.raw["merchant"] == " M1" and r.rows_before == 0 for r in recs)
