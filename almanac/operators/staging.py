"""Tables in the folder that driver and executors share, and components of graphs by rounds over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Buckets that Spark allows a table.
MOST_BUCKETS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where neither the setting nor a checkpoint directory exists (a local test session) is a
    temporary folder made and set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/almanac-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which cuts the lineage.

    The table outlives any executor, so a lost one costs only the tasks that were running.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, by: str, buckets: int, name: str) -> DataFrame:
    """Writes a table into the shared folder dealt by ``by``, and reads it back: grouping or joining it by that column moves none of its rows again.

    A task writes a file for each bucket that it has rows of, so ``df`` should hold the rows of a bucket together.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"almanac_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(min(buckets, MOST_BUCKETS), by).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read any more."""
    if path := getattr(df, "_scratch", None):
        removed(df.sparkSession, path)


#: Neighbours from which on a node is a hub, where a thousandth of all edges is not more: there are 2,000 hubs at most.
HUB = 1000


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long) as (node, component), the smallest node each.

    Alternates large-star and small-star steps until nothing changes.  Every step is an aggregation
    with map-side combining and an equi-join.  The smallest neighbours of hubs, a bounded number,
    are broadcast to their edges, so no task gathers a hub's.  Only a row count and a checksum reach
    the driver.  Self loops and repeated edges are allowed; nulls are dropped.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))

    def met(pairs: DataFrame, low: DataFrame, n: int) -> DataFrame:
        hub = F.col("n") > max(HUB, n // 1000)
        hubs = F.broadcast(low.where(hub).select("a", "low"))
        rest = pairs.join(hubs.select("a"), "a", "left_anti").join(low.where(~hub).select("a", "low"), "a")
        return pairs.join(hubs, "a").unionByName(rest)

    def large(e: DataFrame, n: int) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = lowest(both).withColumn("low", F.least("low", "a"))
        return met(both, low, n).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))

    def small(e: DataFrame, n: int) -> DataFrame:
        # every edge has a > b here
        low = lowest(e)
        moved = met(e, low, n).where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return moved.unionByName(low.select("a", F.col("low").alias("b"))).where("a != b")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    whole = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    ordered = whole.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged(ordered.distinct(), "edges")
    seen = state(now)
    while seen[0]:
        wide = staged(large(now, seen[0]), "wide")
        new = staged(small(wide, seen[0]).distinct(), "edges")
        after = state(new)
        discard(now)
        discard(wide)
        now = new
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
