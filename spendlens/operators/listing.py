"""Filtered, sorted, paged listings and audits.

Listings are computed for every owner at once: a page is a per-owner
``row_number()`` range, which Spark executes as a per-partition
WindowGroupLimit before the shuffle (only ``skip + limit`` rows per owner and
map task travel), and totals are grouped counts joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- fixed values: API limits and choices of the reference ----
PAGE_LIMITS = {"transactions": 200, "anomalies": 200, "imports": 100}
DEFAULT_PAGE = {"transactions": 50, "anomalies": 50, "imports": 20}
TRANSACTION_TYPES = ["debit", "credit"]
SEVERITIES = ["low", "medium", "high"]
RETENTION_DAYS = 90
DEFAULT_CATEGORIES = [
    "Food", "Groceries", "Transportation", "Travel", "Shopping",
    "Entertainment", "Bills", "Utilities", "Healthcare", "Education",
    "Rent", "Salary", "Investment", "Transfer", "Subscription",
    "Cash Withdrawal", "Other",
]
# response projections (P7): what each listing returns
TRANSACTION_FIELDS = ["transaction_id", "transaction_date", "description", "merchant", "amount",
                      "currency", "transaction_type", "category", "is_anomaly", "anomaly_score",
                      "import_id", "reference"]
ANOMALY_FIELDS = ["anomaly_id", "transaction_id", "anomaly_score", "severity", "reason", "created_at"]
IMPORT_FIELDS = ["import_id", "filename", "status", "total_rows", "imported_rows", "failed_rows",
                 "errors", "created_at"]
# unique indexes, by table
UNIQUE_KEYS = {
    "transaction_imports": ["user_id", "file_hash"],
    "categories": ["name", "user_id"],
    "anomalies": ["transaction_id"],
    "recurring_transactions": ["user_id", "merchant"],
    "ml_models": ["name", "version"],
}
# ----------------------------------------------------------------


def validate_page(kind: str, skip: int, limit: int) -> None:
    """Skip >= 0 and 1 <= limit <= the listing's maximum (raises ValueError)."""
    if skip < 0:
        raise ValueError("skip must be >= 0")
    if not 1 <= limit <= PAGE_LIMITS[kind]:
        raise ValueError(f"limit must be between 1 and {PAGE_LIMITS[kind]}")


def validate_choice(value: str | None, allowed: Sequence[str], name: str) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}")


def apply_filters(df: DataFrame, **equals) -> DataFrame:
    """Optional equality filters; None / empty values are skipped."""
    for c, v in equals.items():
        if v:
            df = df.where(F.col(c) == F.lit(v))
    return df


def page(df: DataFrame, owner: str, order: Sequence[Column], skip: int = 0, limit: int = 50,
         kind: str = "transactions") -> DataFrame:
    """O1-O3 + A4 for every owner: rows ``skip+1 .. skip+limit`` in ``order``
    plus ``total`` (count under the same predicate) and ``position``."""
    validate_page(kind, skip, limit)
    w = Window.partitionBy(owner).orderBy(*order)
    ranked = df.withColumn("position", F.row_number().over(w))
    rows = ranked.where((F.col("position") > skip) & (F.col("position") <= skip + limit))
    totals = df.groupBy(owner).agg(F.count(F.lit(1)).alias("total"))
    return rows.join(totals, owner)


def lookup_owned(df: DataFrame, requests: DataFrame, id_col: str, owner: str) -> DataFrame:
    """P10: rows whose (id, owner) pair was requested; a foreign id gives nothing."""
    return df.join(requests.select(id_col, owner).distinct(), [id_col, owner], "left_semi")


def retention(df: DataFrame, ts_col: str, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Keep rows no older than ``days`` before ``as_of``."""
    return df.where(F.col(ts_col) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (NULL groups with NULL)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def audit_unique_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """A14 over several tables (names of ``UNIQUE_KEYS``): a row (table, key, n) for each key that
    occurs more than once; ``key`` joins its parts with ``|``, NULL written as such."""
    found = None
    for name, df in tables.items():
        keys = UNIQUE_KEYS[name]
        text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
        rows = duplicate_keys(df, keys).select(F.lit(name).alias("table"), text.alias("key"), F.col("n").cast("bigint"))
        found = rows if found is None else found.unionByName(rows)
    return found


def insert_if_absent(existing: DataFrame, defaults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Defaults not yet present (null-safe key match) appended to existing."""
    cond = None
    for k in keys:
        c = existing[k].eqNullSafe(defaults[k])
        cond = c if cond is None else cond & c
    missing = defaults.join(existing, cond, "left_anti")
    return existing.unionByName(missing, allowMissingColumns=True)
