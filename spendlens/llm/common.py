"""Shared helpers: files in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a single-machine session (tests) may leave it unset; that gets a folder of its own.
    On a cluster an unset folder is an error: no machine-local folder is ever used there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) \
        or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spendlens-llm-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/spendlens-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame from :func:`stored` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph given as links (a long, b long).

    Returns (node, component) for every node that has a link, component being the smallest
    node reachable. Alternates large-star and small-star steps (Kiveris et al., 2014): each
    step is one aggregation and one join on the node. The minimum per node is written out
    before the join, so the join's two sides have exchanges of their own and a node with very
    many links is split by adaptive execution. Nothing but a row count reaches the driver.
    Null ends and self-links are ignored.
    """
    spark = links.sparkSession
    edges = stored(links.where("a is not null and b is not null and a <> b")
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = _star(_star(edges, large=True), large=False)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    if not mark[0]:
        return spark.createDataFrame([], "node long, component long")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum: unchanged when the star steps no longer change a link."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v), u > v."""
    least = stored(edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), "least")
    if large:
        # every larger neighbour of c is hung on the smallest neighbour of c
        out = edges.select(F.col("v").alias("c"), F.col("u").alias("x")) \
            .join(least, "c", "left").select(F.col("x").alias("u"), F.coalesce("m", "c").alias("v")) \
            .unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    else:
        # the smaller neighbours of c, and c, are hung on the smallest one
        out = edges.select(F.col("u").alias("c"), F.col("v").alias("x")) \
            .join(least, "c").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    out = stored(out.distinct(), "star")
    forget(edges)
    forget(least)
    return out
