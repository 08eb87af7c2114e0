"""What the operators of this subpackage share: hidden columns, blocks of text, order over a whole table."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.operators.staging import connected, discard, removed, scratch_path, shared_dir, staged  # noqa: F401

#: Bytes of text that one block of documents holds on average (see text_blocks).
BLOCK_BYTES = 16 << 20


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns under private names, and those names: what an operator adds clashes with none of them."""
    names = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shown(names: dict[str, str], but: tuple[str, ...] = ()) -> list:
    """The columns of ``hidden`` under their own names, without those in ``but``."""
    return [F.col(own).alias(c) for c, own in names.items() if c not in but]


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def settled(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over: it does when their plans are collected."""
    spark.sparkContext._jvm.System.gc()


def text_blocks(docs: DataFrame, *, text: str = "text", target: int = BLOCK_BYTES) -> int:
    """How many blocks of about ``target`` bytes of text a table needs (one at least)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // target))


def indexed(df: DataFrame, order: list, name: str, value: str | None = None) -> DataFrame:
    """Adds ``_before``: how many rows (or how much of ``value``) stand before each row in ``order``.

    The order is total over the whole table, yet no task sees more than its own range of it: rows
    are dealt by range and staged with their partition's number, the partitions' sums are added up
    (one row a partition), and a window inside each partition does the rest.
    """
    amount = F.col(value) if value else F.lit(1).cast("long")
    names = df.columns
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, name)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    out = ranged.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    out = out.join(sums, "_part").withColumn("_before", (F.col("_base") + F.col("_in")).cast("long"))
    return out.select(*names, "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
