"""Spending analytics declared by the reference but never implemented.

The reference names these (dashboard cards, spending summaries, recurring
payments, forecasts, insights) without code, so the definitions are ours and
documented per function.  All of them aggregate first (per user-month,
user-day, user-merchant) and only then apply small windows, so no window
ever sees more than one user's months or one user-merchant's payments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.operators.running import running_prior_max

DEBIT, CREDIT = "debit", "credit"
# our parameters (the reference gives none)
SES_ALPHA = 0.3
FORECAST_HORIZONS = [7, 30, 90]
BAND_Z = 1.96
RECURRING_MIN_PAYMENTS = 3
RECURRING_BANDS = [("DAILY", 1, 1), ("WEEKLY", 6, 8), ("MONTHLY", 26, 35), ("YEARLY", 350, 380)]


def _is(kind: str):
    return F.col("transaction_type") == kind


def monthly_kpis(txn: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Per user and month -- income, expense, net, running balance,
    savings rate (net / income) and expense change vs the previous active month."""
    m = (txn.withColumn("month", F.date_trunc("month", "transaction_date").cast("date"))
            .groupBy(user_col, "month")
            .agg(F.sum(F.when(_is(CREDIT), F.col("amount")).otherwise(0.0)).alias("income"),
                 F.sum(F.when(_is(DEBIT), F.col("amount")).otherwise(0.0)).alias("expense")))
    w = Window.partitionBy(user_col).orderBy("month")
    prev = F.lag("expense").over(w)
    return (m.withColumn("net", F.col("income") - F.col("expense"))
             .withColumn("balance", F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("savings_rate", F.try_divide(F.col("net"), F.when(F.col("income") != 0, F.col("income"))))
             .withColumn("expense_change", F.try_divide(F.col("expense") - prev, F.when(prev != 0, prev))))


def spending_rollup(txn: DataFrame, grain: str = "month") -> DataFrame:
    """Debit total / count / average by period and category with rollup
    subtotals (per period, and grand total); ``level`` = grouping id."""
    d = txn.where(_is(DEBIT)).withColumn("period", F.date_trunc(grain, "transaction_date").cast("date"))
    return (d.rollup("period", "category")
             .agg(F.grouping_id().alias("level"), F.sum("amount").alias("debit_total"),
                  F.count(F.lit(1)).alias("debit_count"), F.avg("amount").alias("debit_avg")))


def recurring_payments(txn: DataFrame, user_col: str = "user_id", id_col: str = "transaction_id") -> DataFrame:
    """D3: user + merchant with >= 3 debits whose median gap (days; the mean of
    the middle two) falls in a frequency band; confidence = max(0, 1 - std/mean
    of gaps); next date = last date + whole days of the median gap."""
    d = txn.where(_is(DEBIT) & F.col("merchant").isNotNull() & (F.col("merchant") != ""))
    d = d.withColumn("__day", F.to_date("transaction_date"))
    # previous payment date = max date over earlier payments (skew-safe running max)
    d = running_prior_max(d, [user_col, "merchant"], ["__day", id_col],
                          F.date_trunc("month", "__day").cast("date"), F.col("__day"), "__prev")
    d = d.withColumn("gap", F.datediff("__day", "__prev"))
    g = d.groupBy(user_col, "merchant").agg(
        F.count(F.lit(1)).alias("payments"), F.avg("amount").alias("avg_amount"),
        F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("std_gap"),
        F.max("__day").alias("last_date"))
    # exact: gaps are whole days, so a group has as many distinct ones as its span has days at most
    counts = d.where("gap is not null").groupBy(user_col, "merchant", "gap").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(user_col, "merchant")
    below = F.sum("__n").over(group.orderBy("gap"))
    counts = counts.withColumn("__below", below).withColumn("__all", F.sum("__n").over(group))
    holds = lambda rank: (F.col("__below") > rank) & (F.col("__below") - F.col("__n") <= rank)
    lower, upper = F.floor((F.col("__all") - 1) / 2), F.ceil((F.col("__all") - 1) / 2)
    medians = counts.groupBy(user_col, "merchant").agg(
        ((F.max(F.when(holds(lower), F.col("gap"))) + F.max(F.when(holds(upper), F.col("gap")))) / 2).alias("median_gap"))
    g = g.where(F.col("payments") >= RECURRING_MIN_PAYMENTS).join(medians, [user_col, "merchant"])
    freq = None
    for name, lo, hi in RECURRING_BANDS:
        c = F.col("median_gap").between(lo, hi)
        freq = F.when(c, F.lit(name)) if freq is None else freq.when(c, F.lit(name))
    conf = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(
        F.try_divide(F.col("std_gap"), F.when(F.col("mean_gap") != 0, F.col("mean_gap"))), F.lit(0.0)))
    return (g.withColumn("frequency", freq).where(F.col("frequency").isNotNull())
             .select(user_col, "merchant", "frequency", "payments", "avg_amount",
                     "median_gap", conf.alias("confidence"),
                     F.date_add("last_date", F.col("median_gap").cast("int")).alias("next_date")))


def spend_forecast(txn: DataFrame, user_col: str = "user_id", alpha: float = SES_ALPHA) -> DataFrame:
    """Simple exponential smoothing of each user's gap-filled daily debit
    total (level_0 = first day; days without debits count as 0).  Forecast for
    h days = level * h, band = +-1.96 * residual std * sqrt(h), residuals being
    the one-step errors of all days after the first (sample std; 0 with fewer than two).

    A user's daily totals are folded in order of day: one entry per active day, so
    as many as the calendar has at most, however many rows the user has.  The g
    empty days before an active one have the residuals -L, -qL, ... (q = 1 - alpha),
    whose sums have a closed form."""
    q = 1 - alpha
    day = F.to_date("transaction_date")
    daily = txn.where(_is(DEBIT)).groupBy(user_col, day.alias("day")).agg(F.sum("amount").alias("x"))
    days = daily.groupBy(user_col).agg(F.array_sort(F.collect_list(F.struct("day", "x"))).alias("__days"))
    first = F.col("__days")[0]
    start = F.struct(first["x"].alias("level"), first["day"].alias("last"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))

    def after(state: Column, d: Column) -> Column:
        gap = (F.datediff(d["day"], state["last"]) - 1).cast("double")
        kept = F.pow(F.lit(q), gap)
        now = state["level"] * kept
        e = d["x"] - now
        return F.struct((now + alpha * e).alias("level"), d["day"].alias("last"),
                        (state["s1"] - state["level"] * (1 - kept) / (1 - q) + e).alias("s1"),
                        (state["s2"] + state["level"] * state["level"] * (1 - kept * kept) / (1 - q * q) + e * e).alias("s2"))

    rest = F.slice("__days", F.lit(2), F.size("__days"))
    out = days.select(user_col, first["day"].alias("__t0"), F.aggregate(rest, start, after).alias("__end"))
    n = F.datediff("__end.last", "__t0").cast("double")    # residuals: all days but the first
    var = F.when(n >= 2, F.greatest(F.lit(0.0), (F.col("__end.s2") - F.col("__end.s1") * F.col("__end.s1") / n) / (n - 1))).otherwise(0.0)
    out = out.select(user_col, (n + 1).cast("bigint").alias("days"), F.col("__end.level").alias("level"), F.sqrt(var).alias("residual_std"))
    horizons = F.explode(F.array(*[F.lit(h) for h in FORECAST_HORIZONS])).alias("horizon_days")
    return (out.select(user_col, "days", "level", "residual_std", horizons)
               .withColumn("forecast", F.col("level") * F.col("horizon_days"))
               .withColumn("lower", F.greatest(F.lit(0.0), F.col("forecast") - F.lit(BAND_Z) * F.col("residual_std")
                                                * F.sqrt(F.col("horizon_days").cast("double"))))
               .withColumn("upper", F.col("forecast") + F.lit(BAND_Z) * F.col("residual_std")
                           * F.sqrt(F.col("horizon_days").cast("double"))))


def insights(txn: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Deterministic insight rows per user -- top category and top merchant
    by debit spend (ties -> smallest label) and the largest month-over-month
    change in debit spend (ties -> earliest month)."""
    d = txn.where(_is(DEBIT))
    cat = (d.groupBy(user_col, "category").agg(F.sum("amount").alias("v"))
             .groupBy(user_col).agg(F.min_by(F.struct("category", "v"),
                                              F.struct(-F.col("v"), F.col("category"))).alias("b"))
             .select(user_col, F.lit("top_category").alias("insight"), F.col("b.category").alias("label"),
                     F.col("b.v").alias("value")))
    mer = (d.where(F.col("merchant").isNotNull() & (F.col("merchant") != ""))
             .groupBy(user_col, "merchant").agg(F.sum("amount").alias("v"))
             .groupBy(user_col).agg(F.min_by(F.struct("merchant", "v"),
                                              F.struct(-F.col("v"), F.col("merchant"))).alias("b"))
             .select(user_col, F.lit("top_merchant").alias("insight"), F.col("b.merchant").alias("label"),
                     F.col("b.v").alias("value")))
    k = monthly_kpis(txn, user_col)
    w = Window.partitionBy(user_col).orderBy("month")
    ch = (k.withColumn("delta", F.col("expense") - F.lag("expense").over(w)).where(F.col("delta").isNotNull())
            .groupBy(user_col).agg(F.min_by(F.struct("month", "delta"),
                                            F.struct(-F.abs("delta"), F.col("month"))).alias("b"))
            .select(user_col, F.lit("largest_monthly_change").alias("insight"),
                    F.date_format("b.month", "yyyy-MM").alias("label"), F.col("b.delta").alias("value")))
    return cat.unionByName(mer).unionByName(ch)
