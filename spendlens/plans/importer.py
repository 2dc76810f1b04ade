"""Statement import end to end (M18) and its sinks.

gate (S4) -> duplicate files (J1, ledger anti-join) -> records (S1/S2) ->
file errors (S5) -> row parsing (P1-P6, P11) -> summary (A3, P13) ->
categorisation (M8, F11) -> append transactions (S8) -> append ledger (S9)
-> re-scan affected users (M17, best effort).

Transactions are written before the ledger, so a crash in between leaves
rows without a ledger entry rather than a ledger entry blocking a re-import of
rows that were never stored; a replay finds their ``import_id`` and does not
append them again.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators.registry import exists
from spendlens.operators.statement import (ERR_FILE_EMPTY, file_error, first_uploads,
                                           import_summary, parse_rows)
from spendlens.session import stored
from spendlens.sources.statements import accepted, gate, split_records

log = logging.getLogger(__name__)

UNCATEGORIZED = "Uncategorized"   # fixed value (reference fallback category)
REJECT_NO_USER = "The file belongs to no user."


@dataclass
class Store:
    """Parquet tables of the engine under one shared folder."""
    base: str

    def path(self, name: str) -> str:
        return os.path.join(self.base, name)

    def read(self, spark: SparkSession, name: str, schema: str | None = None) -> DataFrame | None:
        """The table; only one that does not exist is empty (or None), a read error raises."""
        p = self.path(name)
        if exists(spark, p):
            return spark.read.parquet(p)
        return spark.createDataFrame([], schema) if schema else None


LEDGER_SCHEMA = ("user_id string, file_hash string, import_id string, filename string, status string, "
                 "total_rows bigint, imported_rows bigint, failed_rows bigint, "
                 "errors array<struct<row:int,message:string>>, created_at timestamp")


def categorize(rows: DataFrame, model=None) -> DataFrame:
    """Category + confidence; no model -> Uncategorized with 0.0."""
    if model is None:
        return rows.withColumn("category", F.lit(UNCATEGORIZED)).withColumn(
            "category_confidence", F.lit(0.0))
    from spendlens.operators import textclass as tc
    docs = tc.prepare(rows.select(F.col("transaction_id").alias("id"), F.col("description")))
    pred = tc.predict_naive_bayes(model, docs) if isinstance(model, tc.NaiveBayesModel) else model.predict(docs)
    return (rows.join(pred.withColumnRenamed("id", "transaction_id"), "transaction_id", "left")
                .withColumn("category", F.coalesce("predicted", F.lit(UNCATEGORIZED)))
                .withColumn("category_confidence", F.coalesce("confidence", F.lit(0.0)))
                .drop("predicted", "confidence"))


def transaction_rows(txn: DataFrame, model=None) -> DataFrame:
    """Parsed transactions with their category, in the columns of the store."""
    return categorize(txn, model).select(
        "transaction_id", "user_id", "transaction_date", "description", "merchant", "amount",
        "currency", "transaction_type", "category", "category_confidence", "import_id", "reference",
        "content_hash", "ingest_seq", F.lit(False).alias("is_anomaly"),
        F.lit(None).cast("double").alias("anomaly_score"), F.current_timestamp().alias("created_at"))


def ledger_rows(summary: DataFrame) -> DataFrame:
    """Import summaries in the columns of the ledger."""
    return summary.select("user_id", "file_hash", "import_id", "filename", "status", "total_rows",
                          "imported_rows", "failed_rows", "errors", "created_at")


def prepare_import(spark: SparkSession, files: DataFrame,
                   ledger: DataFrame | Callable[[DataFrame], DataFrame] | None,
                   default_user: str | None = None):
    """Everything up to the writes for a binaryFile DataFrame (batch or one
    micro-batch).  Returns (transactions, summary, rejected).  ``ledger`` may be
    a function that gives the entries for the batch's file hashes."""
    gated = gate(files.drop("content"))          # metadata only
    rejected = gated.where(F.col("reject_reason").isNotNull()).select("path", "reject_reason")
    acc = accepted(files)
    if "user_id" not in acc.columns:
        acc = acc.withColumn("user_id", F.lit(default_user))
    # upload order: modification time, then path (a unique, sortable key)
    acc = acc.withColumn("user_id", F.col("user_id").cast("string")) \
             .withColumn("file_seq", F.concat(F.lpad(F.unix_micros("modificationTime").cast("string"), 20, "0"),
                                              F.lit("|"), F.col("path")))
    no_user = acc.where("user_id is null").select("path", F.lit(REJECT_NO_USER).alias("reject_reason"))
    acc = acc.where("user_id is not null")
    # duplicates are decided on keys alone; the bytes of the files that are kept are read by one pass
    keys = acc.select("path", "user_id", "file_hash", "file_seq")
    if callable(ledger):
        keys = stored(keys, "uploads")
        ledger = ledger(keys.select("file_hash"))
    dedup = first_uploads(keys, ledger.select("user_id", "file_hash", F.lit("").alias("file_seq"))
                          if ledger is not None else None)
    dup = dedup.where(~F.col("accepted")).select("path", F.lit("This file was already imported").alias(
        "reject_reason"))
    fresh = acc.select("path", "content", "user_id", "file_hash", "file_seq").join(
        dedup.where("accepted").select("path"), "path", "left_semi")
    # parsed once: transactions, summary and rejects are all read from these rows
    recs = stored(split_records(fresh), "records")
    recs = recs.join(recs.where("read_error is not null").select("path").distinct(), "path", "left_anti") \
        .unionByName(recs.where("read_error is not null"))
    recs = recs.withColumn("file_error", F.coalesce("read_error", file_error("header")))
    recs = recs.withColumn("file_error", F.coalesce(
        "file_error", F.when(F.col("row_num").isNull(), F.lit(ERR_FILE_EMPTY))))
    bad_files = recs.where(F.col("file_error").isNotNull()).select(
        "path", F.col("file_error").alias("reject_reason")).distinct()
    ok = recs.where(F.col("file_error").isNull())
    parsed = parse_rows(ok)
    parsed = parsed.withColumn("import_id", F.sha2(F.concat_ws("|", "user_id", "file_hash"), 256))
    summary = (import_summary(parsed, ["user_id", "file_hash", "import_id", "path"])
               .withColumn("filename", F.element_at(F.split("path", "/"), -1))
               .withColumn("created_at", F.current_timestamp()))
    txn = (parsed.where(F.col("error").isNull())
                 .withColumn("transaction_id", F.sha2(F.concat_ws("|", "import_id", F.col("row_num").cast("string")), 256))
                 # order of insertion: uploads by time and path, then the row in the file
                 .withColumn("ingest_seq", F.concat("file_seq", F.lit("|"), F.lpad(F.col("row_num").cast("string"), 10, "0"))))
    return txn, summary, rejected.unionByName(no_user).unionByName(dup).unionByName(bad_files)


def run_import(spark: SparkSession, folder: str, store: Store, model=None,
               default_user: str | None = None, detector=None) -> dict:
    """Import a folder of statements; returns counts.  A detection
    failure never undoes the import."""
    return import_files(spark, spark.read.format("binaryFile").load(folder), store, model,
                        default_user, detector)


def import_files(spark: SparkSession, files: DataFrame, store: Store, model=None,
                 default_user: str | None = None, detector=None) -> dict:
    """M18 on a binaryFile DataFrame (used by the folder import and by T1)."""
    ledger = store.read(spark, "imports", LEDGER_SCHEMA)
    txn, summary, rejected = prepare_import(spark, files, ledger, default_user)
    txn = transaction_rows(txn, model)
    done = store.read(spark, "transactions")
    if done is not None:              # a crash between the two writes left rows without a ledger entry
        txn = txn.join(done.select("import_id").distinct(), "import_id", "left_anti").select(*txn.columns)
    txn = stored(txn, "transactions")  # one parse, two writes + counts
    n_rows = txn.count()
    if n_rows:                        # S8: empty -> no write
        txn.write.mode("append").parquet(store.path("transactions"))
    summary = stored(ledger_rows(summary), "summary")
    summary.write.mode("append").parquet(store.path("imports"))      # S9, after the rows
    result = {"transactions": n_rows, "imports": summary.count(), "rejected": rejected.count()}
    if detector is not None and n_rows:
        try:
            detector(spark, store, txn.select("user_id").distinct())
        except Exception:  # best effort, as in the reference
            log.exception("anomaly re-scan failed after import")
    return result
