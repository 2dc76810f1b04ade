"""Mapping views over the driver tables (FIXTURES.md part B).

The driver data has no bank transactions or statement files, so these views
derive them deterministically from the TPC-H-like tables.  Each Spark view is
plain DataFrame code (joins left to Catalyst/AQE, columns pruned at the scan);
``DUCKDB_VIEWS`` holds the same definitions as SQL text for the oracles.

One deliberate difference from FIXTURES.md: ``labelled_text`` uses the *whole*
document text as the description (no 200-character prefix), so text operators
work on whole texts.
"""

from __future__ import annotations

import csv
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.operators.running import running_row_number
from spendlens.sources.tables import read_table


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def _mod(c: str | Column, m: int) -> Column:
    return F.pmod(c if isinstance(c, Column) else F.col(c), F.lit(m))


def txn_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions: one row per lineitem."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                    "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    od = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    pt = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(pt, li.l_partkey == pt.p_partkey))
    ship = F.col("l_shipdate")
    ymd = F.year(ship) * 10000 + F.month(ship) * 100 + F.dayofmonth(ship)
    spike = _mod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), 97) == 0
    okey_ref = F.lit(100000) + _mod("l_orderkey", 900000)
    pname = F.upper(F.col("p_name"))
    description = (
        F.when(_mod("l_partkey", 4) == 0, F.concat(F.lit("UPI/"), pname, F.lit("/"), _s(okey_ref)))
         .when(_mod("l_partkey", 4) == 1,
               F.concat(F.lit("POS "), pname, F.lit(" NO "), _s(_mod("l_suppkey", 100))))
         .when(_mod("l_partkey", 4) == 2, F.concat(pname, F.lit(" REF"), _s(okey_ref)))
         .otherwise(F.concat(pname, F.lit("*"), _s(F.lit(1000) + _mod("l_orderkey", 9000)))))
    merchant = (F.when(_mod("l_suppkey", 17) == 0, F.lit(None).cast("string"))
                 .when(_mod("l_suppkey", 19) == 0, F.lit(""))
                 .otherwise(F.concat(F.lit("M"), _s(_mod("l_suppkey", 12)))))
    return j.select(
        F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"),
                    _s("l_suppkey"), _s(ymd)).alias("transaction_id"),
        F.col("o_custkey").alias("user_id"),
        ship.alias("transaction_date"),
        description.alias("description"),
        merchant.alias("merchant"),
        F.when(spike, F.col("l_extendedprice") * 8).otherwise(F.col("l_extendedprice")).alias("amount"),
        F.lit("INR").alias("currency"),
        F.when(F.col("l_returnflag") == "R", F.lit("credit")).otherwise(F.lit("debit"))
         .alias("transaction_type"),
        F.col("p_type").alias("category"),
        spike.cast("int").alias("is_injected_anomaly"),
        F.concat(F.lit("imp-"), _s(_mod("l_suppkey", 10))).alias("import_id"),
    )


_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def raw_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unparsed statement rows in four layouts (one row per order)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                   "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    y, m, dd = _s(F.year(d)), _s(F.month(d)), _s(F.dayofmonth(d))
    m2, d2 = F.lpad(m, 2, "0"), F.lpad(dd, 2, "0")
    mon = F.substring(F.lit(_MONTHS), F.month(d) * 3 - 2, 3)
    date_raw = (
        F.when(_mod(k, 23) == 0, F.lit(""))
         .when(_mod(k, 29) == 0, F.lit("not-a-date"))
         .when(_mod(k, 7) == 0, F.concat(y, F.lit("-"), m2, F.lit("-"), d2))
         .when(_mod(k, 7) == 1, F.concat(dd, F.lit("/"), m, F.lit("/"), y))
         .when(_mod(k, 7) == 2, F.concat(m2, F.lit("/"), d2, F.lit("/"), y))
         .when(_mod(k, 7) == 3, F.concat(d2, F.lit("-"), m2, F.lit("-"), y))
         .when(_mod(k, 7) == 4, F.concat(y, F.lit("/"), m, F.lit("/"), dd))
         .when(_mod(k, 7) == 5, F.concat(d2, F.lit(" "), mon, F.lit(" "), y))
         .otherwise(F.concat(F.lit(" "), dd, F.lit("-"), F.upper(mon), F.lit("-"), y, F.lit(" "))))
    desc_raw = (F.when(_mod(k, 31) == 0, F.lit("  "))
                 .otherwise(F.concat(F.lit("ORDER "), _s(_mod(k, 1000)), F.lit(" "),
                                     F.col("o_orderpriority"))))
    tp = F.col("o_totalprice")
    whole = F.floor(tp).cast("bigint")
    amt_raw = (
        F.when(_mod(k, 37) == 0, F.lit("0"))
         .when(_mod(k, 41) == 0, F.lit("abc"))
         .when(_mod(k, 43) == 0, F.lit("12d"))
         .when(_mod(k, 3) == 0, F.concat(F.lit("₹"), _s(F.floor(tp / 1000).cast("bigint")), F.lit(","),
                                          F.lpad(_s(_mod(whole, 1000)), 3, "0"), F.lit(".50")))
         .when(_mod(k, 3) == 1, F.concat(F.lit("-"), _s(whole)))
         .otherwise(F.concat(F.lit(" $"), _s(whole), F.lit(".25 "))))
    type_raw = (F.when(_mod(k, 5) == 0, F.lit(" CR ")).when(_mod(k, 5) == 1, F.lit("credit"))
                 .when(_mod(k, 5) == 2, F.lit("C")).when(_mod(k, 5) == 3, F.lit("debit"))
                 .otherwise(F.lit("")))
    merchant_raw = F.when(_mod(k, 2) == 0, F.lit("")).otherwise(F.concat(F.lit(" M"), _s(_mod(k, 9))))
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("file-"), _s(_mod("o_custkey", 50))).alias("file_id"),
        k.alias("row_key"),
        _mod("o_custkey", 4).alias("layout"),
        date_raw.alias("date_raw"), desc_raw.alias("desc_raw"), amt_raw.alias("amt_raw"),
        type_raw.alias("type_raw"), merchant_raw.alias("merchant_raw"),
    )


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("description"),
                    F.col("lang").alias("category"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return d.select(F.col("doc_id").alias("file_seq"), F.col("source").alias("user_id"),
                    F.sha2(F.col("text"), 256).alias("file_hash"))


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model versions = position of the event within its type (skew-safe rank)."""
    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "value")
    ranked = running_row_number(e, ["event_type"], ["event_id"],
                                F.floor(F.col("event_id") / F.lit(VERSION_BUCKET)), "version")
    return ranked.select(
        F.col("event_type").alias("model_name"), F.col("version").cast("bigint").alias("version"),
        F.when(_mod("event_id", 50) == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value")).alias("score"),
        F.col("event_id"))


# events per bucket when numbering versions; any positive value gives the same answer
VERSION_BUCKET = 4096


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "props", "value")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return e.select(
        F.col("event_id"), F.col("user_id"), F.col("ts"), F.col("event_type").alias("category"),
        F.concat(F.lit("K"), _s(_mod(k, 20))).alias("merchant"), F.col("value").alias("amount"))


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL text (used as CTE prefixes of oracle queries).
# ---------------------------------------------------------------------------
DUCKDB_VIEWS = {
    "txn_star": """
select concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',
              year(l_shipdate)*10000 + month(l_shipdate)*100 + day(l_shipdate)) as transaction_id,
 o_custkey as user_id, l_shipdate as transaction_date,
 case when l_partkey % 4 = 0 then concat('UPI/',upper(p_name),'/',100000 + l_orderkey % 900000)
      when l_partkey % 4 = 1 then concat('POS ',upper(p_name),' NO ',l_suppkey % 100)
      when l_partkey % 4 = 2 then concat(upper(p_name),' REF',100000 + l_orderkey % 900000)
      else concat(upper(p_name),'*',1000 + l_orderkey % 9000) end as description,
 case when l_suppkey % 17 = 0 then null when l_suppkey % 19 = 0 then ''
      else concat('M',l_suppkey % 12) end as merchant,
 case when (l_orderkey * 7 + l_linenumber) % 97 = 0 then l_extendedprice * 8 else l_extendedprice end as amount,
 'INR' as currency,
 case when l_returnflag = 'R' then 'credit' else 'debit' end as transaction_type,
 p_type as category,
 case when (l_orderkey * 7 + l_linenumber) % 97 = 0 then 1 else 0 end as is_injected_anomaly,
 concat('imp-',l_suppkey % 10) as import_id
from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey""",
    "raw_statement": """
select o_custkey as user_id, concat('file-',o_custkey % 50) as file_id, o_orderkey as row_key, o_custkey % 4 as layout,
 case when o_orderkey % 23 = 0 then '' when o_orderkey % 29 = 0 then 'not-a-date'
  when o_orderkey % 7 = 0 then concat(year(o_orderdate),'-',lpad(concat('',month(o_orderdate)),2,'0'),'-',lpad(concat('',day(o_orderdate)),2,'0'))
  when o_orderkey % 7 = 1 then concat(day(o_orderdate),'/',month(o_orderdate),'/',year(o_orderdate))
  when o_orderkey % 7 = 2 then concat(lpad(concat('',month(o_orderdate)),2,'0'),'/',lpad(concat('',day(o_orderdate)),2,'0'),'/',year(o_orderdate))
  when o_orderkey % 7 = 3 then concat(lpad(concat('',day(o_orderdate)),2,'0'),'-',lpad(concat('',month(o_orderdate)),2,'0'),'-',year(o_orderdate))
  when o_orderkey % 7 = 4 then concat(year(o_orderdate),'/',month(o_orderdate),'/',day(o_orderdate))
  when o_orderkey % 7 = 5 then concat(lpad(concat('',day(o_orderdate)),2,'0'),' ',substr('JanFebMarAprMayJunJulAugSepOctNovDec',month(o_orderdate)*3-2,3),' ',year(o_orderdate))
  else concat(' ',day(o_orderdate),'-',upper(substr('JanFebMarAprMayJunJulAugSepOctNovDec',month(o_orderdate)*3-2,3)),'-',year(o_orderdate),' ') end as date_raw,
 case when o_orderkey % 31 = 0 then '  ' else concat('ORDER ',o_orderkey % 1000,' ',o_orderpriority) end as desc_raw,
 case when o_orderkey % 37 = 0 then '0' when o_orderkey % 41 = 0 then 'abc' when o_orderkey % 43 = 0 then '12d'
  when o_orderkey % 3 = 0 then concat('₹',floor(o_totalprice/1000)::bigint,',',lpad(concat('',(floor(o_totalprice)::bigint % 1000)),3,'0'),'.50')
  when o_orderkey % 3 = 1 then concat('-',floor(o_totalprice)::bigint)
  else concat(' $',floor(o_totalprice)::bigint,'.25 ') end as amt_raw,
 case when o_orderkey % 5 = 0 then ' CR ' when o_orderkey % 5 = 1 then 'credit' when o_orderkey % 5 = 2 then 'C'
      when o_orderkey % 5 = 3 then 'debit' else '' end as type_raw,
 case when o_orderkey % 2 = 0 then '' else concat(' M',o_orderkey % 9) end as merchant_raw
from orders""",
    "labelled_text": "select doc_id as id, text as description, lang as category from documents",
    "uploads": "select doc_id as file_seq, source as user_id, sha256(text) as file_hash from documents",
    "metric_history": """
select event_type as model_name,
 row_number() over (partition by event_type order by event_id) as version,
 case when event_id % 50 = 0 then null else value end as score, event_id
from events""",
    "txn_events": """
select event_id, user_id, ts, event_type as category,
 concat('K', cast(json_extract_string(props,'$.k') as int) % 20) as merchant, value as amount
from events""",
}


def duckdb_with(*names: str) -> str:
    """``WITH`` prefix defining the named mapping views for a DuckDB oracle."""
    return "with " + ",\n".join(f"{n} as ({DUCKDB_VIEWS[n]})" for n in names) + "\n"


VIEWS = {
    "txn_star": txn_star,
    "raw_statement": raw_statement,
    "labelled_text": labelled_text,
    "uploads": uploads,
    "metric_history": metric_history,
    "txn_events": txn_events,
}

__all__ = ["VIEWS", "DUCKDB_VIEWS", "duckdb_with", "Window"]


# header of each raw_statement layout (FIXTURES.md): 0 = date,description,amount,type;
# 1 = transaction_date,narration,debit,credit; 2 = date,description,amount; 3 = 0 + merchant
_LAYOUT_HEADERS = {
    0: ["date", "description", "amount", "type"],
    1: ["transaction_date", "narration", "debit", "credit"],
    2: ["date", "description", "amount"],
    3: ["date", "description", "amount", "type", "merchant"],
}


def raw_statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_statement as parser input: ``header`` + ``raw`` map + row number in file.

    Row numbers follow the file order (row_key) starting at 2, computed with
    the skew-safe running rank (one user's file may be huge)."""
    r = raw_statement(spark, sf_dir)
    odd = _mod("row_key", 2) == 1
    cells = {
        0: [F.col("date_raw"), F.col("desc_raw"), F.col("amt_raw"), F.col("type_raw")],
        1: [F.col("date_raw"), F.col("desc_raw"), F.when(odd, F.col("amt_raw")).otherwise(F.lit("")),
            F.when(odd, F.lit("")).otherwise(F.col("amt_raw"))],
        2: [F.col("date_raw"), F.col("desc_raw"), F.col("amt_raw")],
        3: [F.col("date_raw"), F.col("desc_raw"), F.col("amt_raw"), F.col("type_raw"),
            F.col("merchant_raw")],
    }
    header = values = None
    for k in sorted(_LAYOUT_HEADERS):
        h = F.array(*[F.lit(x) for x in _LAYOUT_HEADERS[k]])
        v = F.array(*cells[k])
        header = F.when(F.col("layout") == k, h) if header is None else header.when(F.col("layout") == k, h)
        values = F.when(F.col("layout") == k, v) if values is None else values.when(F.col("layout") == k, v)
    r = r.select("user_id", "file_id", "row_key", header.alias("header"),
                 F.map_from_arrays(header, values).alias("raw"))
    r = running_row_number(r, ["user_id", "file_id"], ["row_key"],
                           F.floor(F.col("row_key") / F.lit(VERSION_BUCKET)), "pos_in_file")
    return r.withColumn("row_num", (F.col("pos_in_file") + 1).cast("int")).drop("pos_in_file")


# rows and bytes of one written statement file at most: well under the upload gate's 10 MB
TASK_FILES, TASK_ROWS = 500, 100_000   # files and rows of a task that writes or reads statements; any numbers give the same rows
FILE_ROWS, FILE_BYTES = 50_000, 8 * 1024 * 1024


def _writers(raw: DataFrame) -> dict[int, int]:
    """Tasks for each layout's files: a small file costs its creation, not its bytes, by which adaptive
    execution would put thousands of them into one task."""
    cores = raw.sparkSession.sparkContext.defaultParallelism
    sizes = raw.groupBy("layout").agg(F.approx_count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("rows")).collect()   # four layouts
    return {r.layout: max(cores, (r.users + r.rows // FILE_ROWS) // TASK_FILES, r.rows // TASK_ROWS) for r in sizes}


def _write_csv(part: DataFrame, folder: str, names: list[str]) -> None:
    """Sorted rows (user_id, rows_before, cells) as one CSV file for each pair, written by the tasks that hold them.

    On a shared disk the tasks create the files themselves: Hadoop's local file system starts a process (chmod) for each
    file, checksum file and folder, which costs a hundred times the file.  Elsewhere by Spark's writer."""
    sc = part.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        fs.delete(path, True)   # overwritten, as below
        part.mapInArrow(_csv_files(fs.makeQualified(path).toUri().getPath(), names), "files long").agg(F.sum("files")).collect()
        return
    (part.write.mode("overwrite").partitionBy("user_id", "rows_before")
         .option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).option("emptyValue", "")
         # tasks move their own files at their end; one by one in the driver takes longer than writing them
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .csv(folder))


def _csv_files(folder: str, names: list[str]):
    """Sorted rows (user_id, rows_before, cells) -> files ``user_id=<id>/rows_before=<n>/part-<task>.csv`` and their number.

    A file is renamed when it is whole; a task that runs again writes the same files over."""
    def value(v) -> str:   # as Spark names the folders of partitionBy
        if v is None or v == "":
            return "__HIVE_DEFAULT_PARTITION__"
        return re.sub(r"""["#%'*/:=?\\{\[\]^\x00-\x1f\x7f]""", lambda m: f"%{ord(m[0]):02X}", str(v))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name, draft = f"part-{task.partitionId():05d}.csv", f".part-{task.taskAttemptId()}"
        at, out, put, n = None, None, None, 0

        def close():
            out.close()
            os.replace(out.name, os.path.join(os.path.dirname(out.name), name))

        for batch in batches:
            cells = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)
            for user, before, *row in cells:
                if out is None or (user, before) != at:
                    if out is not None:
                        close()
                    at, n = (user, before), n + 1
                    own = os.path.join(folder, f"user_id={value(user)}", f"rows_before={before}")
                    os.makedirs(own, exist_ok=True)
                    out = open(os.path.join(own, draft), "w", encoding="utf-8", newline="")
                    put = csv.writer(out, lineterminator="\n").writerow
                    put(names)
                put(row)
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return write


def read_statement_files(spark: SparkSession, folder: str, tasks: int) -> DataFrame:
    """The statement files of a folder with their user and ``rows_before``, read by ``tasks`` tasks: the reader takes every
    file for 4 MB at least, which makes a task of a few small ones, and lists every user's folder in a task of its own
    unless told otherwise.  The columns come from the paths: found as partitions, they take the driver a millisecond a file."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(tasks))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)   # lists the folder
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    # a row without a user is in a folder whose name is no number
    own = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).try_cast("bigint").alias(name)
    return files.select("*", own("user_id"), own("rows_before")).coalesce(tasks)


def write_raw_statement_files(raw: DataFrame, folder: str) -> int:
    """Write raw_statement as CSV statement files by user and layout
    (``layout=<k>/user_id=<id>/rows_before=<n>/part-*.csv``), rows in file order,
    cells verbatim (leading/trailing spaces kept, values with commas quoted).

    A statement of many rows goes on in further files, each within ``FILE_BYTES``
    unless a single row is longer; ``rows_before`` is the number of the
    statement's rows in the files before.  Returns how many tasks suit a reader of them."""
    tasks = _writers(raw)
    odd = _mod("row_key", 2) == 1
    cols = {
        0: [("date", "date_raw"), ("description", "desc_raw"), ("amount", "amt_raw"), ("type", "type_raw")],
        1: [("transaction_date", "date_raw"), ("narration", "desc_raw"),
            ("debit", F.when(odd, F.col("amt_raw")).otherwise(F.lit(""))),
            ("credit", F.when(odd, F.lit("")).otherwise(F.col("amt_raw")))],
        2: [("date", "date_raw"), ("description", "desc_raw"), ("amount", "amt_raw")],
        3: [("date", "date_raw"), ("description", "desc_raw"), ("amount", "amt_raw"), ("type", "type_raw"),
            ("merchant", "merchant_raw")],
    }
    for k, spec in cols.items():
        sel = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in spec]
        names = [name for name, _ in spec]
        # every cell quoted and every character of it escaped: no row is longer in the file
        size = sum((F.coalesce(F.octet_length(n), F.lit(0)).cast("bigint") * 2 + 3 for n in names), F.lit(0))
        rows = running_row_number(raw.where(F.col("layout") == k).select("user_id", "row_key", *sel), ["user_id"], ["row_key"],
                                  F.coalesce(F.floor(F.col("row_key") / F.lit(VERSION_BUCKET)), F.lit(-(1 << 62))), "pos")
        rows = rows.withColumn("chunk", F.floor((F.col("pos") - 1) / F.lit(FILE_ROWS)))
        so_far = F.sum(size).over(Window.partitionBy("user_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("end", so_far).select(
            "*", F.floor((F.col("end") - size) / F.lit(FILE_BYTES)).alias("a"), F.floor(F.col("end") / F.lit(FILE_BYTES)).alias("b"))
        # a row over the border of two pieces (a, b) has a file of its own
        first = F.min("pos").over(Window.partitionBy("user_id", "chunk", "a", "b"))
        part = (rows.select("user_id", (first - 1).alias("rows_before"), "pos", *names)
                    .repartition(tasks.get(k, 1), "user_id", "rows_before").sortWithinPartitions("user_id", "rows_before", "pos").drop("pos"))
        _write_csv(part, f"{folder}/layout={k}", names)
    return max(1, sum(tasks.values()))
