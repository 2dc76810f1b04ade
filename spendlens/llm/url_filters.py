"""URL rules by a sort-merge range join (DataFrame operations only).

A host is turned round (``a.example.org`` -> ``org example a``), each label closed by a
separator byte, so a rule for a host and its subdomains is one interval of keys; a rule's path
is an interval of the paths below its host. Intervals of one kind are nested or disjoint.
:func:`sweep` sorts interval ends and points together and keeps the stack of open intervals in
window functions: slot d of the stack holds the interval last opened at depth d.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most ranges that the boundaries are cut into; their first keys are the only rows sent to the driver.
RANGES = 256
#: Boundaries in a range at least, so that few rules still leave the points dealt by salt over all partitions.
WIDTH = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty when it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("__url")))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from right to left, each closed by byte 01; bytes 01 and 02 inside labels are escaped."""
    safe = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x03")), F.lit("\x01"), F.lit("\x02\x02"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), "\x01"), F.lit("\x01"))


def path_key(host: Column, path: Column) -> Column:
    """Key of a path below a host key: no host key holds byte 00 in front of another key's end."""
    return F.concat(F.encode(host, "utf-8"), F.unhex(F.lit("00")), F.encode(path, "utf-8"))


def after_prefix(key: Column) -> Column:
    """First key past all that start with ``key``: byte FF is in no UTF-8 text."""
    return F.concat(key, F.unhex(F.lit("FF")))


def sweep(points: DataFrame, intervals: DataFrame, out: str) -> DataFrame:
    """Add to each point the stack (array, outermost first) of the intervals open at its key.

    points: any columns and ``__key`` binary. intervals: ``lo``, ``hi`` binary (hi excluded) and
    ``val`` string, distinct, nested or disjoint. Rows with a null key get an empty stack.
    """
    spark = points.sparkSession
    ends = intervals.select(F.col("lo").alias("pos"), F.lit(1).alias("step"), "val").unionByName(
        intervals.select(F.col("hi").alias("pos"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("val")))
    # the rules only: one sort of a table that does not grow with the pages
    order = Window.partitionBy(F.lit(0)).orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("depth", F.sum("step").over(order)).withColumn("n", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy("pos", "step")))
    size, deepest = ends.agg(F.count("*"), F.max("depth")).first()
    empty = F.array().cast("array<string>")
    if not size:
        return points.withColumn(out, empty)
    slots = [F.last(F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("val"))
                    .when(F.col("depth") < d, F.lit("")), ignorenulls=True).over(order) for d in range(1, deepest + 1)]
    width = max(WIDTH, -(-size // RANGES))
    ends = ends.withColumn("stack", F.filter(F.array(*slots), lambda x: x.isNotNull() & (x != "")))
    firsts = [bytes(r.pos) for r in ends.where((F.col("n") - 1) % width == 0).orderBy("n").select("pos").collect()]
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // len(firsts))
    split = F.array(*[F.unhex(F.lit(k.hex())) for k in firsts])
    part = F.when(F.col("__key").isNull(), F.lit(0)).otherwise(F.size(F.filter(split, lambda s: s <= F.col("__key"))))
    payload = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    rows = points.select(part.alias("part"), F.pmod(F.xxhash64(payload), F.lit(salts)).cast("int").alias("salt"),
                         F.col("__key").alias("pos"), F.lit(1).alias("point"),
                         F.lit(None).cast("array<string>").alias("stack"), payload.alias("row"))
    # the boundaries of a range go to each of its salts; the first one brings the stack already open there
    marks = ends.select((F.floor((F.col("n") - 1) / width) + 1).cast("int").alias("part"),
                        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "pos",
                        F.lit(0).alias("point"), "stack", F.col("n").alias("nth"))
    both = rows.withColumn("nth", F.lit(0)).unionByName(marks.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)))
    over = Window.partitionBy("part", "salt").orderBy("pos", "point", "nth")
    return both.withColumn("top", F.last("stack", ignorenulls=True).over(over)).where("point = 1") \
        .select("row.*", F.coalesce("top", empty).alias(out))


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` in a struct ``page``, with host, path, rule and verdict.

    rules: host, path, verdict ('allow' or 'block'). A rule fits its host and all subdomains when
    the url's path starts with the rule's path; the longest rule (host and path together, then the
    longer host) wins; no rule: ``default``. Of equal rules with both verdicts, block wins; rules
    with a null host, path or verdict are ignored. Null urls and urls without ``://`` have empty
    host and path and so fit no rule with a host. Every input row gives one row.
    """
    lowered = F.translate("host", UPPER, LOWER)
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')") \
        .select(lowered.alias("host"), "path", "verdict").groupBy("host", "path") \
        .agg(F.max("verdict").alias("verdict")) \
        .withColumn("hkey", host_key(F.col("host")))
    host, path = host_and_path(F.col("__url"))
    points = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(f"`{url}`").alias("__url")) \
        .select("page", host.alias("host"), path.alias("path"))
    bytes_of = lambda c: F.encode(c, "utf-8")
    hosts = rules.select("hkey").distinct().select(
        bytes_of(F.col("hkey")).alias("lo"),
        bytes_of(F.concat(F.expr("substring(hkey, 1, length(hkey) - 1)"), F.lit("\x02"))).alias("hi"),
        F.col("hkey").alias("val"))
    found = sweep(points.withColumn("__key", bytes_of(host_key(F.col("host")))), hosts, "hosts").drop("__key")
    key = path_key(F.col("hkey"), F.col("path"))
    # what a path sweep returns: sortable length, verdict and rule in one string
    told = F.concat(F.lpad(F.length(F.concat("host", "path")).cast("string"), 9, "0"), F.lit(" "),
                    F.lpad(F.length("host").cast("string"), 9, "0"), F.lit(" "),
                    F.rpad("verdict", 5, " "), F.lit(" "), "host", "path")
    paths = rules.select(key.alias("lo"), after_prefix(key).alias("hi"), told.alias("val"))
    deepest = _nesting(hosts)
    best = F.lit(None).cast("string")
    for d in range(deepest):  # one sweep for each level of nested rule hosts
        slot = F.get("hosts", F.lit(d))
        found = sweep(found.withColumn("__key", path_key(slot, F.col("path"))), paths, "__open").drop("__key")
        found = found.withColumn(f"__best{d}", F.try_element_at("__open", F.lit(-1))).drop("__open")
    if deepest:
        best = F.array_max(F.array(*[F.col(f"__best{d}") for d in range(deepest)]))
    return found.withColumn("__best", best).select(
        "page", "host", "path", F.substring("__best", 27, 1 << 30).alias("rule"),
        F.coalesce(F.rtrim(F.substring("__best", 21, 5)), F.lit(default)).alias("verdict"))


def _nesting(intervals: DataFrame) -> int:
    """How many intervals are open at once at most."""
    ends = intervals.select(F.col("lo").alias("pos"), F.lit(1).alias("step")).unionByName(
        intervals.select(F.col("hi").alias("pos"), F.lit(-1).alias("step")))
    depth = F.sum("step").over(Window.partitionBy(F.lit(0)).orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, 0))
    return ends.select(depth.alias("d")).agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as a table of literals (host, path, verdict)."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
