"""Looking up earlier rows, due retries, details, and rows to leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.parse import canonical_url
from almanac.functions.urls import same_page


def by_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is listed; a list of any length."""
    return rows.join(keys.select(column).distinct(), column, "left_semi")


def with_previous(rows: DataFrame, previous: DataFrame, *, legacy: Column | None = None) -> DataFrame:
    """Rows with ``previous_id``, the release that held their observation before.

    ``rows`` and ``previous`` are keyed by provider, label and record.  Where ``legacy`` holds and
    there is no exact match, the one earlier row with the record is taken, if there is just one.
    """
    keys = ["provider", "label", "record"]
    exact = previous.select(*keys, F.col("release_id").alias("_exact"))
    out = rows.join(exact, keys, "left")
    if legacy is None:
        return out.withColumnRenamed("_exact", "previous_id")
    single = previous.groupBy("provider", "record").agg(F.count(F.lit(1)).alias("_n"), F.min("release_id").alias("_single")).where("_n = 1").drop("_n")
    out = out.join(single, ["provider", "record"], "left")
    return out.withColumn("previous_id", F.coalesce("_exact", F.when(legacy, F.col("_single")))).drop("_exact", "_single")


def carried_over(rows: DataFrame, previous: DataFrame, columns: list[str], key: str = "release_id") -> DataFrame:
    """Rows with the columns that the resolver owns taken from the earlier row; null for new ones."""
    return rows.drop(*columns).join(previous.select(key, *columns), key, "left")


def in_window_of(rows: DataFrame, releases: DataFrame, date: str, start: Column, end: Column, key: str = "release_id") -> DataFrame:
    """Rows whose release is dated inside a window."""
    return rows.join(releases.where(F.col(date).between(start, end)).select(key), key, "left_semi")


def exact_details(rows: DataFrame, details: DataFrame, slug: str = "slug") -> DataFrame:
    """Rows with the details of exactly their slug; a row without such details has nulls."""
    return rows.join(details, slug, "left")


def retry_due(attempted: Column, now: Column, url: Column, old_url: Column, promised: Column, hours: int = 24) -> Column:
    """Whether a detail page is due: a promised field is missing, and it was never tried, a day ago, or elsewhere."""
    missing = ~F.forall(promised, lambda x: F.coalesce(x, F.lit("")) != "")
    stale = attempted.isNull() | (attempted <= now - F.make_dt_interval(F.lit(0), F.lit(hours))) | ~url.eqNullSafe(old_url)
    return missing & stale


def widest(images: Column) -> Column:
    """The address of the widest of an array of (width, url); the first by address among equals."""
    best = F.array_min(F.transform(images, lambda x: F.struct((-x["width"]).alias("w"), x["url"].alias("url"))))
    return best["url"]


def split_by(rows: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to leave out): an unknown verdict keeps."""
    out = F.coalesce(rule, F.lit(False))
    return rows.where(~out), rows.where(out)


def reason_counts(rows: DataFrame, category: str, reason: str) -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(category, reason).agg(F.count(F.lit(1)).alias("n"))


def suffix_owners(releases: DataFrame, records: DataFrame) -> DataFrame:
    """Releases that an excluded record owns by their id's last part; an equi-join on that part."""
    last = F.substring_index("release_id", ":", -1)
    return releases.withColumn("record", last).join(records.select(F.col("record").cast("string")).distinct(), "record", "left_semi").drop("record")


def backfilled(releases: DataFrame) -> DataFrame:
    """Observations made from releases that have none: keys from provenance JSON, the record patched with the address."""
    source = F.coalesce(F.get_json_object("provenance", "$[0].source"), F.col("source_id"))
    record = F.coalesce(F.get_json_object("provenance", "$[0].sourceRecordId"), F.substring_index("release_id", ":", -1))
    patch = F.create_map(F.lit("title"), F.col("title"), F.lit("releaseUrl"), F.col("release_url"))
    return releases.select(source.alias("provider"), F.col("label_id").alias("label"), record.alias("record"), "release_id", F.to_json(F.map_filter(patch, lambda _, v: v.isNotNull())).alias("raw"))


def roster(text: Column) -> Column:
    """Entities of a roster in JSON: slug, name, count; entries without a slug are left out."""
    parsed = F.from_json(text, "array<struct<slug: string, name: string, count: long>>")
    return F.filter(parsed, lambda x: F.coalesce(x["slug"], F.lit("")) != "")


def of_release(pages: DataFrame, asked: str, page: str, reached: str) -> DataFrame:
    """Detail pages that are of the release asked for: by the address that they claim, else by the one that was reached.

    A page that claims another address is refused, as is one without a claim that a request was led away to.
    """
    claim = canonical_url(F.col(page))
    return pages.where(F.when(claim.isNotNull(), same_page(F.col(asked), claim)).otherwise(F.coalesce(same_page(F.col(asked), F.col(reached)), F.lit(True))))
