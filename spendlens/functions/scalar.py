"""Column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def log_amount_pos(amount) -> Column:
    """log1p(max(amount, 0))."""
    return F.log1p(F.greatest(col(amount), F.lit(0.0)))


def weekday_monday0(ts) -> Column:
    """day of week with Monday = 0 (``weekday``, not ``dayofweek``)."""
    return F.weekday(col(ts))


def is_weekend(ts) -> Column:
    """1.0 on Saturday/Sunday else 0.0."""
    return F.when(F.weekday(col(ts)) >= 5, F.lit(1.0)).otherwise(F.lit(0.0))


def present(c) -> Column:
    """Python truthiness of an optional string: not NULL and not empty."""
    return col(c).isNotNull() & (col(c) != F.lit(""))


def severity(score) -> Column:
    """>= 0.75 high, >= 0.5 medium, else low."""
    s = col(score)
    return (F.when(s >= 0.75, F.lit("high")).when(s >= 0.5, F.lit("medium"))
             .otherwise(F.lit("low")))


def zscore(amount, mean, std) -> Column:
    """(amount - mean) / std when std > 0, else 0.0."""
    return F.when(col(std) > 0, F.try_divide(col(amount) - col(mean), col(std))).otherwise(F.lit(0.0))


def safe_ratio(num, den) -> Column:
    """num / den with 0.0 on a zero or NULL denominator (zero_division=0)."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def py_float_text(x) -> Column:
    """Render a double the way Python's ``str(float)`` does for money-sized
    values: plain decimal (no exponent), shortest digits, at least one decimal
    (``438.0``, ``10000000.0``, ``12.5``)."""
    v = col(x)
    # in [1e-3, 1e7) Java's Double.toString prints the same shortest digits
    plain_range = (F.abs(v) >= 1e-3) & (F.abs(v) < 1e7)
    d = F.format_number(v, 10)  # thousands separators, fixed 10 decimals
    trimmed = F.regexp_replace(F.regexp_replace(d, ",", ""), "0+$", "")
    slow = F.regexp_replace(trimmed, r"\.$", ".0")
    return F.when(plain_range, v.cast("string")).otherwise(slow)
