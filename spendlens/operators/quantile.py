"""Exact quantiles of a column of any size.

Equal-width counts over the column's range, then of the one or two bins that hold the wanted
ranks, until such a bin has few distinct values: these are counted one by one.  Each round is one
aggregate of at most ``BINS`` rows; a value that very many rows share is its bin's least
and greatest value and ends the search at once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: Rows of a bin whose distinct values are brought to the driver.
FEW = 10_000


def _value_at(values: DataFrame, rank: int, lo: float, hi: float) -> float:
    """The value of that rank (from 0) among finite ones from ``lo`` to ``hi``; column ``v``."""
    while lo < hi:
        # halves, as the width of a range of doubles may be no double
        width = hi / 2 - lo / 2
        inside = values.where((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
        few = width <= 0
        if not few:
            at = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.lit(lo / 2)) / F.lit(width) * BINS))
            bins = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            for b in sorted(bins, key=lambda b: b.bin):
                if rank < b.n:
                    break
                rank -= b.n
            lo, hi, few = b.lo, b.hi, b.n <= FEW
        if few and lo < hi:
            counts = values.where((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))).groupBy("v").agg(F.count("*").alias("n")).collect()
            for c in sorted(counts, key=lambda c: c.v):
                if rank < c.n:
                    return c.v
                rank -= c.n
    return lo


def exact_quantile(df: DataFrame, col: str, p: float) -> float | None:
    """The quantile with linear interpolation between the two middle values; None without values.

    NULL and NaN are no values; infinite ones are, at the ends.  ``df`` is read a few
    times, so it should be a stored table.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    v = df.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    finite = v.where(F.abs("v") < float("inf"))
    n, low = v.agg(F.count("*"), F.count_if(F.col("v") == float("-inf"))).first()
    if not n:
        return None
    m, lo, hi = finite.agg(F.count("*"), F.min("v"), F.max("v")).first()
    place = p * (n - 1)

    def at(rank: int) -> float:
        if rank < low:
            return -math.inf
        return math.inf if rank >= low + m else _value_at(finite, rank - low, lo, hi)

    first = at(math.floor(place))
    part = place - math.floor(place)
    if not part:
        return first
    second = at(math.ceil(place))
    return first if first == second else first + part * (second - first)
