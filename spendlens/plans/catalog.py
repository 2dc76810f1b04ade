"""

Each entry is ``(spark, sf_dir) -> DataFrame`` over the mapping views; the
matching DuckDB oracle text lives in ``spendlens.plans.oracles``.  Doubles are
rounded to 6 digits at the end of each query (the oracle does the same) so
the value hashes compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators.expanding import expanding_features
from spendlens.operators.explain import with_reasons
from spendlens.plans.common import rounded
from spendlens.session import stored
from spendlens.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _txn(spark: SparkSession, sf_dir: str, *cols) -> DataFrame:
    """Some columns of the transactions, joined once and stored: later steps read them several times."""
    return stored(views.txn_star(spark, sf_dir).select(*cols), "transactions")


@register("txn_features")
def q_txn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1-W3, W8, F2-F4, F8 codes: expanding features + primary reason for every row."""
    feat = with_reasons(expanding_features(_txn(spark, sf_dir, "transaction_id", "user_id", "transaction_date", "amount", "category", "merchant")))
    return rounded(feat.select(
        "transaction_id", "user_id", "log_amount", "category_zscore", "merchant_zscore",
        "is_new_merchant", "day_of_week", "is_weekend",
        F.col("cat_n").alias("prior_category_n"), F.col("mer_n").alias("prior_merchant_n"),
        "reason_code", "typical_amount", "multiple"))


# ---------------------------------------------------------------- statements
from spendlens.operators.statement import first_uploads, import_summary, parse_rows  # noqa: E402


def _parsed_statements(spark, sf_dir):
    return parse_rows(views.raw_statement_cells(spark, sf_dir))


@register("statement_rows")
def q_statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw row parsed, with its error or its content hash."""
    return rounded(_parsed_statements(spark, sf_dir).select(
        "user_id", "file_id", "row_num", "transaction_date", "description", "merchant", "amount",
        "transaction_type", "currency", "reference", "error", "content_hash"))


@register("import_summary")
def q_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-file counts, status and the first 50 errors."""
    # parsed rows feed two aggregates (counts, first errors): materialise once
    s = import_summary(_parsed_statements(spark, sf_dir).checkpoint(), ["user_id", "file_id"])
    errs = F.array_join(F.transform("errors", lambda e: F.concat(
        e["row"].cast("string"), F.lit(":"), e["message"])), " | ")
    return s.select("user_id", "file_id", "total_rows", "imported_rows", "failed_rows", "status",
                    F.when(F.size("errors") > 0, errs).alias("first_errors"))


@register("duplicate_uploads")
def q_duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-file duplicates per (user, sha256) rejected, earliest upload wins."""
    return first_uploads(views.uploads(spark, sf_dir)).select(
        "file_seq", "user_id", "file_hash", "accepted", "duplicate_of")


# ---------------------------------------------------------------- text classification
from spendlens.operators import textclass as tc  # noqa: E402


def _text(spark, sf_dir, keep_clean: bool = False):
    """Prepared documents, materialised once: only what later steps read."""
    cols = ["id", "category", "unigrams"] + (["clean_description"] if keep_clean else [])
    return tc.stratified_split(tc.with_terms(tc.materialize(tc.prepare(tc.balanced(views.labelled_text(spark, sf_dir))).select(*cols))))


def _nb(spark, sf_dir):
    d = _text(spark, sf_dir)
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    model = tc.fit_naive_bayes(train)
    pred = tc.predict_naive_bayes(model, test).join(
        test.select("id", F.col("category").alias("truth")), "id")
    return stored(pred, "predictions")   # metrics and reports read it several times


@register("text_terms")
def q_text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + M1: cleaned description and 1-2-gram term counts per document (whole texts)."""
    d = _text(spark, sf_dir, keep_clean=True)
    n = F.size("unigrams").cast("bigint")
    return d.select("id", "clean_description", n.alias("n_unigrams"),
                    F.when(n > 0, 2 * n - 1).otherwise(n).alias("n_terms"))   # and all adjacent pairs


@register("text_split")
def q_text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: deterministic stratified 80/20 split (seed 42)."""
    return tc.stratified_split(views.labelled_text(spark, sf_dir).select("id", "category"))


@register("class_balance")
def q_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + A13: sorted labels of the train split with balanced class weights."""
    train = _text(spark, sf_dir).where(~F.col("is_test"))
    return rounded(tc.class_table(train).select("category", F.col("n_c").cast("bigint").alias("n_c"),
                                                "weight"))


@register("tfidf_weights")
def q_tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: smoothed-idf TF-IDF, L2-normalised, fitted and applied on the train split."""
    train = _text(spark, sf_dir).where(~F.col("is_test"))
    return rounded(tc.fit_tfidf(train))


@register("nb_predictions")
def q_nb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes fitted on train, class + confidence for each test document."""
    return rounded(_nb(spark, sf_dir).select("id", "truth", "predicted", "confidence"))


@register("nb_confusion")
def q_nb_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix in long form."""
    return tc.confusion(_nb(spark, sf_dir)).withColumn("n", F.col("n").cast("bigint"))


@register("nb_metrics")
def q_nb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro precision / recall / F1."""
    return rounded(tc.macro_metrics(tc.confusion(_nb(spark, sf_dir))))


@register("nb_report")
def q_nb_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification report rows."""
    return rounded(tc.classification_report(tc.confusion(_nb(spark, sf_dir))))


# ---------------------------------------------------------------- anomaly detection
from spendlens.operators.evaluation import binary_metrics  # noqa: E402
from spendlens.plans import detect as det  # noqa: E402
from spendlens.functions.scalar import severity  # noqa: E402


def _trained(spark, sf_dir):
    feat = det.feature_table(views.txn_star(spark, sf_dir), extra=["is_injected_anomaly"])
    model, train_scored = det.train_detector(feat)
    return feat, model, train_scored


@register("forest_scores")
def q_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation forest fitted on all transactions' features; score,
    decision (score - offset) and flag for every transaction."""
    feat, model, scored = _trained(spark, sf_dir)
    return scored.select("transaction_id", "user_id", "score", "decision",
                         (F.col("decision") < 0).alias("is_anomaly"))


@register("forest_train_metrics")
def q_forest_train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 on the training run: precision / recall / F1 against injected anomalies."""
    feat, model, scored = _trained(spark, sf_dir)
    return binary_metrics(scored.withColumn("pred", (F.col("decision") < 0).cast("int")),
                          "is_injected_anomaly", "pred")


@register("detect_anomalies")
def q_detect_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection for every user with enough history: flag, per-user
    normalised score, severity and one explanation per flagged transaction."""
    feat, model, scored = _trained(spark, sf_dir)
    return det.detect(feat, model, scored=scored).drop("decision")


@register("detect_summary")
def q_detect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + F12: per-user scan status, message and counts."""
    txn = views.txn_star(spark, sf_dir)
    feat, model, scored = _trained(spark, sf_dir)
    return det.scan_summary(txn, det.detect(feat, model, scored=scored))


@register("history_gate")
def q_history_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users below the 10-transaction minimum are not scored."""
    txn = views.txn_star(spark, sf_dir)
    s = det.scan_summary(txn, None, model_ready=True)
    return s.select("user_id", "transactions_scanned",
                    (F.col("status") != "insufficient_data").alias("eligible"),
                    F.when(F.col("status") == "insufficient_data", F.col("message")).alias("message"))


@register("score_normalize")
def q_score_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 + F7 + A12: per-user min-max normalisation of a raw score (lower =
    more unusual; here -log1p(amount)) and its severity band."""
    t = _txn(spark, sf_dir, "transaction_id", "user_id", (-F.log1p("amount")).alias("decision"))
    s = det.per_user_scale(t).withColumn("anomaly_score", det.normalized_score())
    return rounded(s.select("transaction_id", "user_id", "anomaly_score",
                            severity("anomaly_score").alias("severity")))


@register("binary_metrics")
def q_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 on the labels table: quality as truth, toxic as prediction."""
    from spendlens.sources.tables import read_table
    return rounded(binary_metrics(read_table(spark, sf_dir, "labels", "quality", "toxic"),
                                  "quality", "toxic"))


# ---------------------------------------------------------------- registry
from spendlens.operators import registry as reg  # noqa: E402


@register("model_promotion")
def q_model_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion decision of every version (ties promote, missing metric = -inf)."""
    p = reg.promotions(views.metric_history(spark, sf_dir))
    return rounded(p.select("model_name", "version", "score", "promoted"))


@register("model_status")
def q_model_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16 + A11: per model readiness, active / latest / next version."""
    s = reg.model_status(views.metric_history(spark, sf_dir))
    return s.select("model_name", "is_ready", F.col("active_version").cast("bigint"),
                    F.col("latest_version").cast("bigint"), F.col("next_version").cast("bigint"),
                    F.col("versions").cast("bigint"))


# ---------------------------------------------------------------- listings
from spendlens.operators import listing as lst  # noqa: E402


@register("transactions_page")
def q_transactions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 + P7 + P8 + A4: first page (50) of every user's debits, newest first."""
    txn = lst.apply_filters(views.txn_star(spark, sf_dir), transaction_type="debit", category=None)
    p = lst.page(txn, "user_id", [F.col("transaction_date").desc(), F.col("transaction_id")],
                 skip=0, limit=50)
    fields = [c for c in lst.TRANSACTION_FIELDS if c in txn.columns]
    return rounded(p.select("user_id", F.col("position").cast("bigint"),
                            F.col("total").cast("bigint"), *fields))


@register("imports_page")
def q_imports_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 + A4 over accepted uploads: newest 20 per user."""
    up = first_uploads(views.uploads(spark, sf_dir)).where("accepted")
    p = lst.page(up, "user_id", [F.col("file_seq").desc()], skip=0, limit=20, kind="imports")
    return p.select("user_id", "file_seq", "file_hash", F.col("position").cast("bigint"),
                    F.col("total").cast("bigint"))


@register("retention_window")
def q_retention_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within 90 days of the latest transaction date."""
    txn = views.txn_star(spark, sf_dir)
    as_of = txn.agg(F.max("transaction_date")).scalar()
    return lst.retention(txn, "transaction_date", as_of).select(
        "transaction_id", "user_id", "transaction_date")


@register("unique_key_audit")
def q_unique_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, file hash) keys that occur more than once."""
    d = lst.duplicate_keys(views.uploads(spark, sf_dir), ["user_id", "file_hash"])
    return d.withColumn("n", F.col("n").cast("bigint"))


@register("unique_keys")
def q_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unique keys of all tables, audited on unconstrained rows for each of them."""
    txn = views.txn_star(spark, sf_dir)
    return lst.audit_unique_keys({
        "transaction_imports": views.uploads(spark, sf_dir),
        "categories": txn.select(F.col("category").alias("name"), "user_id"),
        "anomalies": txn.where("is_injected_anomaly = 1"),
        "recurring_transactions": txn.where("transaction_type = 'debit'"),
        "ml_models": views.metric_history(spark, sf_dir).select(F.col("model_name").alias("name"), F.floor(F.col("version") / 2).alias("version"))})


@register("owned_lookup")
def q_owned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: every transaction asked for by id, credits by a stranger: those rows that belong to whoever asks."""
    txn = views.txn_star(spark, sf_dir)
    asks = txn.select("transaction_id", F.when(F.col("transaction_type") == "credit", F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    return rounded(lst.lookup_owned(txn, asks, "transaction_id", "user_id").select("transaction_id", "user_id", "amount"))


@register("category_defaults")
def q_category_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System categories (user NULL) inserted where absent, null-safe keys."""
    existing = (views.txn_star(spark, sf_dir)
                .select(F.col("category").alias("name"), F.col("user_id").cast("string"))
                .distinct().withColumn("is_system", F.lit(False)))
    defaults = spark.createDataFrame([(c, None, True) for c in lst.DEFAULT_CATEGORIES],
                                     "name string, user_id string, is_system boolean")
    return lst.insert_if_absent(existing, defaults, ["name", "user_id"])


def _w5_scored(txn: DataFrame) -> DataFrame:
    t = txn.select("transaction_id", "user_id", "is_injected_anomaly", (-F.log1p("amount")).alias("decision"))
    s = det.per_user_scale(t).where(F.col("__n") >= det.MIN_TRANSACTIONS_FOR_DETECTION)
    return s.withColumn("anomaly_score", det.normalized_score()) \
            .withColumn("is_anomaly", F.col("anomaly_score") >= 0.75).drop("decision", "__n", "__min", "__max")


def _new_store(spark, name):
    import uuid

    from spendlens.plans.scan import open_store
    from spendlens.session import scratch_path
    return open_store(scratch_path(spark, f"{name}-{uuid.uuid4().hex}"))


def _written_back(spark, sf_dir):
    """A store with unscanned transactions and old anomaly records, after a scan was written back to it."""
    from spendlens.plans.scan import write_back
    from spendlens.sources.snapshot import Change
    txn = _txn(spark, sf_dir, "transaction_id", "user_id", "is_injected_anomaly", "amount")
    rows = txn.select("transaction_id", "user_id", F.lit(False).alias("is_anomaly"), F.lit(None).cast("double").alias("anomaly_score"))
    old = txn.where("is_injected_anomaly = 1").select("user_id", "transaction_id", F.lit("previous").alias("source"))
    store = _new_store(spark, "scanned")
    at = store.commit(spark, [Change("transactions", rows), Change("anomalies", old)], store.current(spark))
    write_back(spark, store, at, _w5_scored(txn), sorted(at.tables["transactions"]),
               records=lambda s: s.where("is_anomaly").select("user_id", "transaction_id", F.lit("current").alias("source")))
    return store


@register("anomaly_flags_update")
def q_anomaly_flags_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows get a new flag and score, others keep their old values; read back from the store."""
    out = _written_back(spark, sf_dir).read(spark, "transactions")
    return rounded(out.select("transaction_id", "user_id", "is_anomaly", "anomaly_score"))


@register("anomaly_replace")
def q_anomaly_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned user's anomaly records are replaced (users with no new
    anomaly lose their old ones); read back from the store."""
    return _written_back(spark, sf_dir).read(spark, "anomalies").select("user_id", "transaction_id", "source")


@register("import_rescan")
def q_import_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 + M18: anomaly records after two imports, the last month's transactions second; each import's
    users are scanned over their whole stored histories (score and bands of ``score_normalize``)."""
    from spendlens.plans.scan import scan
    from spendlens.sources.snapshot import Change
    txn = _txn(spark, sf_dir, "transaction_id", "user_id", "transaction_date", "amount").withColumn(
        "is_anomaly", F.lit(False)).withColumn("anomaly_score", F.lit(None).cast("double"))
    last = txn.agg(F.max("transaction_date")).scalar()
    recent = F.col("transaction_date") > last - F.expr("INTERVAL 30 DAYS")

    def score(rows: DataFrame) -> DataFrame:
        s = det.per_user_scale(rows.select("transaction_id", "user_id", (-F.log1p("amount")).alias("decision")))
        s = s.where(F.col("__n") >= det.MIN_TRANSACTIONS_FOR_DETECTION).withColumn("anomaly_score", det.normalized_score())
        return s.withColumn("is_anomaly", F.col("anomaly_score") >= 0.75).withColumn("severity", severity("anomaly_score")).withColumn("reason", F.lit("amount"))

    store = _new_store(spark, "rescan")
    for rows in (txn.where(~recent), txn.where(recent)):
        store.commit(spark, [Change("transactions", rows)], store.current(spark))
        scan(spark, store, score, rows)
    return rounded(store.read(spark, "anomalies").select("user_id", "transaction_id", "anomaly_score", "severity"))


# ---------------------------------------------------------------- whole-history feature sets
from spendlens.operators import history as hist  # noqa: E402


@register("history_features_a")
def q_history_features_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4a + A1 + A2: whole-history feature set A per user."""
    # descriptions, all of them different, are only read where there is no merchant
    description = F.when(F.col("merchant").isNull(), F.col("description")).alias("description")
    f = hist.features_a(_txn(spark, sf_dir, "transaction_id", "user_id", "transaction_date", description, "merchant", "category", "amount"))
    return rounded(f.select("transaction_id", "user_id", "merchant_key", "log_amount", "day_of_week",
                            "day_of_month", "merchant_frequency", "is_new_merchant",
                            "category_frequency", "amount_zscore_category", "amount_zscore_merchant"))


@register("history_features_b")
def q_history_features_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4b + A1 + A2: whole-history feature set B per user."""
    f = hist.features_b(_txn(spark, sf_dir, "transaction_id", "user_id", "transaction_date", "merchant", "category", "amount"))
    return rounded(f.select("transaction_id", "user_id", "log_amount", "category_amount_zscore",
                            "merchant_amount_zscore", "merchant_frequency_ratio",
                            "category_frequency_ratio", "is_new_merchant", "day_of_week", "day_of_month"))


# ---------------------------------------------------------------- analytics (second tier)
from spendlens.operators import analytics as an  # noqa: E402


@register("monthly_kpis")
def q_monthly_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income, expense, net, running balance, savings rate, expense trend."""
    k = an.monthly_kpis(views.txn_star(spark, sf_dir))
    return rounded(k.select("user_id", "month", "income", "expense", "net", "balance",
                            "savings_rate", "expense_change"), 2)


@register("spending_rollup")
def q_spending_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly debit totals by category with rollup subtotals."""
    r = an.spending_rollup(views.txn_star(spark, sf_dir), "month")
    return rounded(r.select("period", "category", F.col("level").cast("bigint"), "debit_total",
                            F.col("debit_count").cast("bigint"), "debit_avg"), 2)


@register("spending_grains")
def q_spending_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily and weekly debit totals by category with rollup subtotals; averages in whole cents, rounded down."""
    txn = views.txn_star(spark, sf_dir)
    day, week = (an.spending_rollup(txn, g).withColumn("grain", F.lit(g)) for g in ("day", "week"))
    cents = F.round(F.col("debit_total") * 100).cast("bigint")
    return day.unionByName(week).select("grain", "period", "category", F.col("level").cast("bigint"), F.round("debit_total", 2).alias("debit_total"),
                                        F.col("debit_count").cast("bigint"), (F.floor(cents / F.col("debit_count")) / 100).alias("debit_avg"))


@register("recurring_payments")
def q_recurring_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: recurring debits per user and merchant."""
    r = an.recurring_payments(views.txn_star(spark, sf_dir))
    return rounded(r.withColumn("payments", F.col("payments").cast("bigint")), 4)


@register("spend_forecast")
def q_spend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7/30/90-day debit forecast per user (exponential smoothing + band)."""
    f = an.spend_forecast(views.txn_star(spark, sf_dir))
    # to the cent, half cents up: smoothing whole cents often gives exact halves, which the last bits would decide
    cent = lambda c: (F.floor(F.col(c) * 100 + 0.5001) / 100).alias(c)
    return f.select("user_id", F.col("horizon_days").cast("int"), "days", cent("forecast"), cent("lower"), cent("upper"))


@register("insights")
def q_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top category, top merchant, largest month-over-month change per user."""
    return rounded(an.insights(views.txn_star(spark, sf_dir)), 2)


# ---------------------------------------------------------------- model comparison, anomalies page
@register("categorizer_candidates")
def q_categorizer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4-M6 + O5: logistic regression, one-vs-rest SVM and naive Bayes on one
    split, macro metrics per candidate and the chosen one."""
    from spendlens.plans.train import compare_candidates
    return compare_candidates(spark, views.labelled_text(spark, sf_dir))


@register("anomalies_page")
def q_anomalies_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 + P7 + P8 + A4: each user's first page (50) of high-severity anomalies, newest first, as the listing
    returns them.  Scores as in ``score_normalize``; a record's time is its transaction's."""
    from spendlens.plans.scan import anomaly_records
    txn = _txn(spark, sf_dir, "transaction_id", "user_id", "is_injected_anomaly", "amount", "transaction_date")
    scored = _w5_scored(txn).withColumn("severity", severity("anomaly_score"))
    times = txn.select("transaction_id", F.col("transaction_date").alias("time"))
    # scored and joined once: the page and its totals both read these rows
    high = stored(lst.apply_filters(scored.where("is_anomaly"), severity="high").select("user_id", "transaction_id", "anomaly_score").join(times, "transaction_id"), "high")
    p = lst.page(high, "user_id", [F.col("time").desc(), F.col("transaction_id")], 0, 50, kind="anomalies")
    # only the rows of a page become whole records
    shown = p.withColumn("severity", F.lit("high")).withColumn("reason", F.lit("amount")).withColumn("is_anomaly", F.lit(True))
    return rounded(anomaly_records(shown, "time", "position", "total").withColumn("created_at", F.col("time")).select(
        "user_id", *lst.ANOMALY_FIELDS, F.col("position").cast("bigint"), F.col("total").cast("bigint")))


# ---------------------------------------------------------------- linear models and the detection side at given values
from spendlens.operators import forest  # noqa: E402

def _given_linear(spark, sf_dir):
    """The split documents, M2 fitted on the train split, and a linear model whose weights follow a rule, not a fit."""
    from spendlens.operators import linear
    d = _text(spark, sf_dir)
    train = d.where(~F.col("is_test"))
    fitted = tc.FittedTfidf(train)
    idf = fitted.idf()
    classes = tc.class_table(train).collect()
    i = range(1, len(classes) + 1)
    weights = idf.select("term", F.array(*[((F.length("term") + 3 * c) % 7 - 3) / 10.0 for c in i]).alias("w")).unionByName(
        spark.range(1).select(F.lit(linear.BIAS).alias("term"), F.array(*[F.lit(0.1 * c) for c in i]).alias("w")))
    return d, fitted, linear.LinearModel([c.category for c in classes], idf, weights)


@register("svm_gradient")
def q_svm_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: objective and gradient of every class's squared-hinge problem on the train split, at given weights."""
    from spendlens.operators import linear
    d, fitted, model = _given_linear(spark, sf_dir)
    train, k = d.where(~F.col("is_test")), len(model.labels)
    x = stored(linear.with_bias(fitted.weights(), train), "values")
    place = F.array_position(F.array(*[F.lit(c) for c in model.labels]), F.col("category")).cast("int") - 1
    docs = stored(train.join(tc.class_table(train).select("category", "weight"), "category").select("id", place.alias("label"), "weight")
                  .join(linear.times(x, model.weights, "w", k, "m"), "id"), "margins")
    loss = linear.SquaredHinge(k)
    g = linear.gradient(x, docs, model.weights, loss)
    slopes = stored(g, "gradient").agg(F.array(*[F.sqrt(F.sum(F.col("g")[i] ** 2)) for i in range(k)]).alias("gradient_norm"),
                   F.max(F.when(F.col("term") == linear.BIAS, F.col("g"))).alias("intercept_gradient"))
    values = linear.objective(docs, model.weights, loss)
    rows = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(zip(model.labels, values))], "i int, category string, objective double")
    return rounded(rows.crossJoin(F.broadcast(slopes)).select(  # one row beside one row a class
        "category", "objective", *[F.element_at(c, F.col("i") + 1).alias(c) for c in ("gradient_norm", "intercept_gradient")]), 4)


@register("categorizer_margins")
def q_categorizer_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 + O6: class of the greatest margin and softmax confidence of every test document, at given weights."""
    d, _, model = _given_linear(spark, sf_dir)
    test = d.where("is_test")
    m = stored(model.margins(test), "margins")
    top = m.select("id", F.array_max("m").alias("margin"))
    return rounded(model.choose(m).join(top, "id").select("id", "predicted", "margin", "confidence"))


def _given_scores(spark, sf_dir):
    """A score for every transaction; a third of all rows have the same one."""
    score = F.when(F.col("transaction_type") == "credit", F.lit(-8.0)).otherwise(-F.log1p("amount"))
    return stored(views.txn_star(spark, sf_dir).select("transaction_id", "user_id", score.alias("score")), "scores")


@register("flag_threshold")
def q_flag_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 + M14: the exact interpolated 5 % threshold of a score, and how many rows lie below it."""
    from spendlens.operators.quantile import exact_quantile
    s = _given_scores(spark, sf_dir)
    t = F.lit(exact_quantile(s, "score", forest.CONTAMINATION))
    return rounded(s.agg(F.max(t).alias("threshold"), F.count("*").alias("n"), F.count_if(forest.flag((F.col("score") - t))).alias("flagged"),
                         F.max(F.lit(exact_quantile(s, "score", 0.9))).alias("upper")))


@register("scan_summary")
def q_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + F12 + M14: every user's scan status, message and counts, rows below the threshold being flagged."""
    from spendlens.operators.quantile import exact_quantile
    s = _given_scores(spark, sf_dir)
    flagged = s.withColumn("is_anomaly", forest.flag(F.col("score") - F.lit(exact_quantile(s, "score", forest.CONTAMINATION))))
    return det.scan_summary(s, flagged)


@register("forest_path_score")
def q_forest_path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 + M14: scores of every transaction by three given trees (tree, node, feature, threshold, left, right, size, depth)."""
    import pandas as pd

    from spendlens.operators.expanding import FEATURE_NAMES
    at = FEATURE_NAMES.index
    nodes = [(0, 0, at("log_amount"), 9.8765, 1, 2, 8, 0), (0, 1, -1, 0.0, -1, -1, 3, 1), (0, 2, at("category_zscore"), 0.54321, 3, 4, 5, 1),
             (0, 3, -1, 0.0, -1, -1, 1, 2), (0, 4, -1, 0.0, -1, -1, 4, 2),
             (1, 0, at("is_new_merchant"), 0.5, 1, 4, 8, 0), (1, 1, at("day_of_week"), 3.5, 2, 3, 7, 1), (1, 2, -1, 0.0, -1, -1, 2, 2),
             (1, 3, -1, 0.0, -1, -1, 5, 2), (1, 4, -1, 0.0, -1, -1, 1, 1),
             (2, 0, at("merchant_zscore"), -0.12345, 1, 2, 8, 0), (2, 1, -1, 0.0, -1, -1, 6, 1), (2, 2, at("is_weekend"), 0.5, 3, 4, 2, 1),
             (2, 3, -1, 0.0, -1, -1, 1, 2), (2, 4, -1, 0.0, -1, -1, 1, 2)]
    pdf = pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    model = forest.ForestModel(FEATURE_NAMES, [0.0] * 6, [1.0] * 6, pdf, psi=8, offset=-0.55)
    f = expanding_features(_txn(spark, sf_dir, "transaction_id", "user_id", "transaction_date", "amount", "category", "merchant")).select("transaction_id", "user_id", *FEATURE_NAMES)
    return rounded(forest.decision(model, f).select("transaction_id", "user_id", "score", "is_anomaly"))


@register("event_features")
def q_event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1-W3 cross-check on dense event histories (sub-second timestamps, event_id tie-break)."""
    ev = stored(views.txn_events(spark, sf_dir).withColumnRenamed("ts", "transaction_date"), "events")
    f = expanding_features(ev, seq_col="event_id", bucket=F.to_date("transaction_date"))
    return rounded(f.select("event_id", "user_id", "category_zscore", "merchant_zscore", "is_new_merchant",
                            F.col("cat_n").alias("prior_category_n"), F.col("mer_n").alias("prior_merchant_n")))


@register("statement_files")
def q_statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 S2 S4 J1 + parsing through real files: every user's raw statement rows
    are written as CSV files (by user and layout, rows in key order, a long
    statement in several files) into the shared checkpoint folder, then imported
    from the folder.  A file that the gate refuses gives one row: its reason as
    ``error``, no ``row_num``."""
    import uuid

    from spendlens.session import scratch_path
    folder = scratch_path(spark, f"statement-files-{uuid.uuid4().hex}")
    tasks = views.write_raw_statement_files(views.raw_statement(spark, sf_dir), folder)
    rows = _imported_rows(spark, views.read_statement_files(spark, folder, tasks))
    return rounded(rows.select(F.col("user_id").cast("bigint").alias("user_id"), "row_num",
                               "transaction_date", "description", "merchant", "amount",
                               "transaction_type", "currency", "reference", "error", "content_hash"))


def _imported_rows(spark, files):
    """All parsed rows (good and bad) of the accepted files, numbered on over the files of
    a statement, and one row for each file that the gate refuses, its reason as ``error``."""
    from spendlens.operators.statement import file_error, parse_rows
    from spendlens.sources.statements import accepted, gate, split_records
    acc = accepted(files)
    recs = split_records(acc.select("path", "content", "user_id", "rows_before", "file_hash"))
    ok = recs.where(file_error("header").isNull() & F.col("row_num").isNotNull())
    ok = ok.withColumn("row_num", (F.col("row_num") + F.col("rows_before")).cast("int"))
    refused = gate(files).where(F.col("reject_reason").isNotNull()).select("user_id", F.col("reject_reason").alias("error"))
    return parse_rows(ok).unionByName(refused, allowMissingColumns=True)
