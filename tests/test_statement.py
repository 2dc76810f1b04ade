"""Statement parsing goldens (FIXTURES part A) through real CSV files."""

import hashlib
import os
from datetime import datetime

from pyspark.sql import functions as F

from spendlens.functions.parsing import parse_amount, parse_date
from spendlens.plans.importer import Store, prepare_import, run_import


def _write(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text.encode(encoding))


def _parse(spark, folder, user="u1"):
    files = spark.read.format("binaryFile").load(folder)
    txn, summary, rejected = prepare_import(spark, files, None, default_user=user)
    return txn, summary, rejected


def test_date_formats(spark):
    cases = {"2026-01-05": datetime(2026, 1, 5), "01/02/2026": datetime(2026, 2, 1),
             "12/31/2025": datetime(2025, 12, 31), "5-JAN-2026": datetime(2026, 1, 5),
             "05  Jan 2026": datetime(2026, 1, 5), "2026/1/5": datetime(2026, 1, 5),
             "30/02/2026": None, "05/01/26": None, "2026-01-05 10:00": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.d for r in df.select("s", parse_date("s").alias("d")).collect()}
    assert got == cases


def test_amounts(spark):
    cases = {"438.00": 438.0, " -200 ": -200.0, "₹1,234.50": 1234.5, " $12.25 ": 12.25,
             "12d": None, "(12)": None, "abc": None, "1_000": None, "nan": None, "": None, "1e3": 1000.0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.a for r in df.select("s", parse_amount("s").alias("a")).collect()}
    assert got == cases


def test_plain_statement_and_hash(spark, tmpdir_path):
    _write(tmpdir_path, "plain.csv", "date,description,amount,type\n"
           "2026-01-05,SWIGGY ORDER,438.00,debit\n2026-01-06,SALARY JAN,65000,credit\n"
           "2026-01-07,AMAZON,2499,debit\n")
    txn, summary, rejected = _parse(spark, tmpdir_path)
    s = summary.collect()[0]
    assert (s.status, s.total_rows, s.imported_rows, s.failed_rows) == ("completed", 3, 3, 0)
    rows = {r.description: r for r in txn.collect()}
    assert rows["SWIGGY ORDER"].amount == 438.0 and rows["SWIGGY ORDER"].transaction_type == "debit"
    assert rows["SALARY JAN"].transaction_type == "credit"
    assert rows["AMAZON"].currency == "INR"
    expect = hashlib.sha256("u1|2026-01-05T00:00:00|SWIGGY ORDER|438.0|debit".encode()).hexdigest()
    assert rows["SWIGGY ORDER"].content_hash == expect
    assert rejected.count() == 0


def test_partial_statement_error_row_number(spark, tmpdir_path):
    _write(tmpdir_path, "partial.csv", "date,description,amount,type\n"
           "2026-01-05,A,10,debit\nnot-a-date,B,20,debit\n2026-01-07,C,30,debit\n")
    txn, summary, _ = _parse(spark, tmpdir_path)
    s = summary.collect()[0]
    assert (s.status, s.imported_rows, s.failed_rows) == ("partial", 2, 1)
    assert [(e.row, e.message) for e in s.errors] == [(3, "Unrecognized date format: 'not-a-date'")]


def test_debit_credit_and_synonyms(spark, tmpdir_path):
    _write(tmpdir_path, "dc.csv", "Transaction Date,Narration,Debit,Credit\n"
           "05/01/2026,RENT,1500,\n06/01/2026,SALARY,,65000\n")
    txn, _, _ = _parse(spark, tmpdir_path)
    got = sorted((r.description, r.amount, r.transaction_type) for r in txn.collect())
    assert got == [("RENT", 1500.0, "debit"), ("SALARY", 65000.0, "credit")]


def test_sign_inference_type_override_optional(spark, tmpdir_path):
    _write(tmpdir_path, "a.csv", "date,description,amount\n2026-01-05,X,-200\n2026-01-06,Y,300\n")
    _write(tmpdir_path, "b.csv", "date,description,amount,type\n2026-01-05,P,438,DR\n2026-01-06,Q,65000,Cr\n")
    _write(tmpdir_path, "c.csv", "date,description,amount,merchant,reference\n2026-01-05,Z,10, Shop , R1 \n")
    txn, _, _ = _parse(spark, tmpdir_path)
    got = {r.description: (r.amount, r.transaction_type, r.merchant, r.reference) for r in txn.collect()}
    assert got["X"] == (200.0, "debit", None, None)
    assert got["Y"] == (300.0, "credit", None, None)
    assert got["P"][1] == "debit" and got["Q"][1] == "credit"
    assert got["Z"] == (10.0, "credit", "Shop", "R1")


def test_row_errors_and_file_errors(spark, tmpdir_path):
    _write(tmpdir_path, "rows.csv", "date,description,amount\nbad,X,10\n2026-01-05,Y,0\n2026-01-05,,5\n")
    _write(tmpdir_path, "cols.csv", "foo,bar\n1,2\n")
    _write(tmpdir_path, "noamt.csv", "date,description\n2026-01-05,X\n")
    _write(tmpdir_path, "notes.txt", "hello")
    _write(tmpdir_path, "empty.csv", "")
    txn, summary, rejected = _parse(spark, tmpdir_path)
    s = summary.collect()[0]
    assert s.status == "failed"
    assert [(e.row, e.message) for e in s.errors] == [
        (2, "Unrecognized date format: 'bad'"), (3, "Transaction amount is zero"), (4, "Missing description")]
    reasons = {os.path.basename(r.path): r.reject_reason for r in rejected.collect()}
    assert reasons["notes.txt"] == "Only .csv files are supported."
    assert "empty.csv" not in reasons   # Spark's file listing skips zero-length files
    assert reasons["cols.csv"].startswith("Could not find required 'date' and 'description' columns.")
    assert reasons["noamt.csv"].startswith("Could not find an 'amount' column")


def test_latin1_and_bom(spark, tmpdir_path):
    _write(tmpdir_path, "l1.csv", "date,description,amount\n2026-01-05,CAFÉ,10\n", encoding="latin-1")
    _write(tmpdir_path, "bom.csv", "﻿date,description,amount\n2026-01-05,TEA,5\n")
    txn, _, _ = _parse(spark, tmpdir_path)
    assert sorted(r.description for r in txn.collect()) == ["CAFÉ", "TEA"]


def test_import_end_to_end_duplicates_and_users(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    body = "date,description,amount,type\n2026-01-05,A,10,debit\n"
    _write(os.path.join(src, "user_id=u1"), "s.csv", body)
    _write(os.path.join(src, "user_id=u2"), "s.csv", body)   # same bytes, other user: allowed
    store = Store(os.path.join(tmpdir_path, "store"))
    r1 = run_import(spark, src, store)
    assert r1["transactions"] == 2 and r1["imports"] == 2
    r2 = run_import(spark, src, store)                        # replay: both are duplicates
    assert r2["transactions"] == 0 and r2["rejected"] == 2
    t = spark.read.parquet(store.path("transactions"))
    assert t.count() == 2 and t.where(F.col("category") == "Uncategorized").count() == 2


def test_faulty_files_are_rejected_and_the_rest_is_imported(spark, tmpdir_path):
    from spendlens.plans.importer import REJECT_NO_USER, Store, prepare_import, run_import
    import os
    folder = os.path.join(tmpdir_path, "in")
    good = "date,description,amount\n2026-01-05,SHOP,10\n"
    files = {"a.csv": good, "cr.csv": good.replace("\n", "\r"), "nul.csv": good + '"2026-01-06,x,1', "big.csv": good + f"2026-01-06,{'y' * 200_000},5\n",
             "e.csv": "", "t.txt": good}
    for user in ("user_id=1", "user_id=__HIVE_DEFAULT_PARTITION__"):
        os.makedirs(os.path.join(folder, user))
    for n, (name, text) in enumerate(files.items()):
        with open(os.path.join(folder, "user_id=1", name), "w", newline="") as f:
            f.write(text.replace("SHOP", f"SHOP{n}"))
    with open(os.path.join(folder, "user_id=__HIVE_DEFAULT_PARTITION__", "n.csv"), "w") as f:
        f.write(good)
    store = Store(os.path.join(tmpdir_path, "store"))
    first = run_import(spark, folder, store)
    rows = store.read(spark, "transactions")
    assert {r.description for r in rows.collect()} >= {"SHOP0", "SHOP1", "y" * 200_000}
    assert first["rejected"] == 2 and first["transactions"] == rows.count()
    _, _, rejected = prepare_import(spark, spark.read.format("binaryFile").load(folder), None)
    assert REJECT_NO_USER in {r.reject_reason for r in rejected.collect()}
    # a crash between the two writes: rows are there, the ledger is not
    import shutil
    shutil.move(store.path("imports"), store.path("imports-lost"))
    again = run_import(spark, folder, store)
    assert again["transactions"] == 0 and store.read(spark, "transactions").count() == first["transactions"]
    # a ledger that can't be read is no empty ledger
    import pytest
    shutil.rmtree(store.path("imports"))
    os.makedirs(store.path("imports"))
    with open(os.path.join(store.path("imports"), "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        run_import(spark, folder, store)


def test_a_statement_over_the_gates_size_keeps_its_rows_and_refused_files_are_reported(spark, tmpdir_path, monkeypatch):
    from spendlens.plans.catalog import _imported_rows
    from spendlens.sources import views
    from spendlens.sources.statements import MAX_UPLOAD_BYTES, REJECT_SIZE
    n = 180_000
    raw = spark.range(n).selectExpr(
        "if(id % 1000 = 999, 8L, 4L) as user_id", "id as row_key", "0 as layout", "'2024-01-05' as date_raw",
        "concat('ORDER, ', id, ' of a user with very many rows in one layout') as desc_raw", "'12.50' as amt_raw",
        "'debit' as type_raw", "'' as merchant_raw")
    views.write_raw_statement_files(raw, f"{tmpdir_path}/files")
    files = spark.read.format("binaryFile").load(f"{tmpdir_path}/files")
    sizes = files.groupBy("user_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).orderBy("user_id").collect()
    assert sizes[0].n > MAX_UPLOAD_BYTES and sizes[0].most < MAX_UPLOAD_BYTES
    rows = _imported_rows(spark, files)
    key = F.regexp_extract("description", "ORDER, ([0-9]+)", 1).cast("long")
    got = rows.select("user_id", "row_num", key.alias("key"), "error").toPandas().sort_values("key")
    assert got.error.isna().all() and got.key.tolist() == list(range(n))
    assert all(x.row_num.tolist() == list(range(2, len(x) + 2)) for _, x in got.groupby("user_id"))
    # long rows: files bounded by bytes; a file over the limit gives a reject row and no others
    monkeypatch.setattr(views, "FILE_BYTES", 2000)
    some = raw.where("row_key < 40").withColumn("desc_raw", F.expr("repeat('x', if(row_key = 7, 5000, 300))"))
    views.write_raw_statement_files(some, f"{tmpdir_path}/long")
    assert spark.read.format("binaryFile").load(f"{tmpdir_path}/long").where("length > 2100").count() == 1
    folder = f"{tmpdir_path}/long/layout=0/user_id=9/rows_before=0"
    os.makedirs(folder)
    _write(folder, "big.csv", "date,description,amount,type\n" + "2024-01-05,x,1,debit\n" * 600_000)
    got = _imported_rows(spark, spark.read.format("binaryFile").load(f"{tmpdir_path}/long")).collect()
    assert sorted(r.row_num for r in got if r.user_id == 4) == list(range(2, 42))
    assert [(r.row_num, r.error) for r in got if r.user_id == 9] == [(None, REJECT_SIZE)]
