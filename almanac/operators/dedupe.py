"""One row per key: last write, first seen, precedence, and budgeted selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; a filter that Spark turns into a limit per group."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")


def last_write(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return first_by(rows, keys, [F.desc_nulls_last(ordinal)])


def first_seen(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return first_by(rows, keys, [F.asc_nulls_last(ordinal)])


def by_precedence(rows: DataFrame, keys: list[str], verdict: str, ranks: dict[str, int], ordinal: str) -> DataFrame:
    """The verdict with the lowest rank wins, the earliest among equals; verdicts without a rank come last."""
    rank = F.coalesce(*(F.when(F.col(verdict) == name, F.lit(n)) for name, n in ranks.items()), F.lit(1 << 30))
    return first_by(rows, keys, [rank.asc(), F.asc_nulls_last(ordinal)])


def queue_cap(cap: float | None) -> int | None:
    """None for no limit, else a whole number from 0."""
    return None if cap is None else max(0, int(cap // 1))


def capped(rows: DataFrame, order: list[Column], cap: float | None) -> DataFrame:
    n = queue_cap(cap)
    ordered = rows.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def stalest(rows: DataFrame, at: str, key: str, k: int = 25) -> DataFrame:
    """The ``k`` rows longest unverified; unreadable times first."""
    return rows.orderBy(F.asc_nulls_first(at), F.asc(key)).limit(k)


def budgeted(rows: DataFrame, attempt: str, date: str, key: str, k: int = 50) -> DataFrame:
    """Never attempted first, oldest date first; then the oldest attempt."""
    return rows.orderBy(F.asc_nulls_first(attempt), F.asc_nulls_last(F.when(F.col(attempt).isNull(), F.col(date))), F.asc(key)).limit(k)


def recent(rows: DataFrame, at: str, key: str, n: int | None = None, most: int = 50, default: int = 10) -> DataFrame:
    """The latest rows, 10 unless asked for, from 1 to 50."""
    return rows.orderBy(F.desc_nulls_last(at), F.asc(key)).limit(max(1, min(most, default if n is None else n)))


def claimed_twice(rows: DataFrame, alias: str, owner: str) -> DataFrame:
    """Aliases that more than one owner claims: alias, owners, and the first and last of them."""
    return rows.groupBy(alias).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner")).where("owners > 1")
