"""The read side: windows, statistics, search, health, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.classify import error_class
from almanac.functions.parse import percent


def in_window(rows: DataFrame, date: str, start: Column, end: Column) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both included; a plain range that reaches the scan."""
    return rows.where((F.col(date) >= start) & (F.col(date) <= end))


def listing(rows: DataFrame, date: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(date), F.asc(key))


def with_links(releases: DataFrame, links: DataFrame, key: str = "release_id") -> DataFrame:
    """Releases with their live and dead link counts; zero where there is none."""
    rolled = links.groupBy(key).agg(F.count_if(~F.col("dead")).alias("live_links"), F.count_if("dead").alias("dead_links"))
    return releases.join(rolled, key, "left").fillna(0, ["live_links", "dead_links"])


def window_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("live_links") > 0).alias("live"),
        F.count_if(F.col("live_links") == 0).alias("unmatched"),
        F.coalesce(F.sum("dead_links"), F.lit(0)).alias("dead_links"),
        F.count_if("metadata_poor").alias("metadata_poor"),
    )


def feed_counts(rows: DataFrame, source: str, label: str) -> DataFrame:
    """Counts by source and by source and label in one pass; ``label`` is null for whole sources."""
    return rows.groupingSets([[source], [source, label]], source, label).agg(F.count(F.lit(1)).alias("n"), F.grouping(label).cast("int").alias("whole"))


def zero_filled(feeds: DataFrame, counts: DataFrame, keys: list[str], column: str = "n") -> DataFrame:
    return feeds.join(counts, keys, "left").fillna(0, [column])


def tier_histogram(rows: DataFrame, tier: str = "tier", weight: Column | None = None) -> DataFrame:
    """One row with a count for each of the four tiers, zeros included; a row counts as often as ``weight`` says, or once."""
    if weight is None:
        weight = F.lit(1)
    return rows.agg(*(F.coalesce(F.sum(F.when(F.col(tier) == t, weight)), F.lit(0)).cast("long").alias(f"tier_{t}") for t in range(4)))


def run_status(outcomes: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run whether every outcome was good, and the first error."""
    return outcomes.groupBy(key).agg(F.bool_and("ok").alias("ok"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ordinal"))).alias("error"))


def haystack(columns: list[str]) -> Column:
    """What a search looks at: the columns' texts in lower case, in one."""
    return F.lower(F.concat_ws(" ", *columns))


def searched(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold a text, by one pass over all; many searches of the same rows go by postings.Index."""
    return rows.where(haystack(columns).contains(query.lower()))


def month_groups(rows: DataFrame, date: str) -> DataFrame:
    """Rows by month and year, those without a date under Undated."""
    return rows.groupBy(F.coalesce(F.date_format(date, "MMMM yyyy"), F.lit("Undated")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def suggestions(rows: DataFrame, columns: list[str], lists: list[str] = []) -> DataFrame:
    """Distinct values of columns and list columns, in order."""
    every = F.concat(F.array(*(F.col(c).cast("string") for c in columns)), *lists)
    return rows.select(F.explode(every).alias("suggestion")).where("suggestion is not null and suggestion != ''").distinct().orderBy("suggestion")


def source_split(rows: DataFrame, source: str, main: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the main catalogue, all others): disjoint, together everything; unknown sources are others."""
    own = F.coalesce(F.col(source).isin(*main), F.lit(False))
    return rows.where(own), rows.where(~own)


def catalogue_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    live = F.count_if(F.col("live_links") > 0)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), live.alias("live"), percent(live, F.count(F.lit(1))).alias("percent"))


def feed_health(feeds: DataFrame, releases: DataFrame) -> DataFrame:
    """Per feed its class of error, releases, those with a live link and their percent.

    A feed of a label counts that label's releases, a whole source all of its own.
    """
    live = F.count_if(F.col("live_links") > 0)
    whole = releases.groupBy("source_id").agg(F.count(F.lit(1)).alias("releases"), live.alias("live")).withColumn("label_id", F.col("source_id"))
    child = releases.where("label_id != source_id").groupBy("source_id", "label_id").agg(F.count(F.lit(1)).alias("releases"), live.alias("live"))
    counts = whole.unionByName(child)
    out = feeds.join(counts, ["source_id", "label_id"], "left").fillna(0, ["releases", "live"])
    return out.withColumn("health", error_class(F.col("last_error"))).withColumn("percent", percent(F.col("live"), F.col("releases")))


def visible_feeds(feeds: DataFrame) -> DataFrame:
    """A healthy whole source is hidden where rows of its labels speak for it."""
    child = feeds.where("label_id != source_id").select("source_id").distinct().withColumn("has_child", F.lit(True))
    rows = feeds.join(child, "source_id", "left")
    return rows.where("label_id != source_id or coalesce(last_error, '') != '' or has_child is null").drop("has_child")


def label_choices(rows: DataFrame, label: str, name: str, ordinal: str) -> DataFrame:
    """Labels with their first name, number of rows and first place."""
    return rows.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(label).agg(F.min_by(name, ordinal).alias("name"), F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_seen"))


def health_summary(feeds: DataFrame) -> DataFrame:
    return feeds.agg(*(F.count_if(F.col("health") == kind).alias(kind) for kind in ("ok", "unimplemented", "config", "failing")))


def numbered_links(links: DataFrame, keys: tuple[str, ...] = ("release_id", "source"), order: str = "url") -> DataFrame:
    """Live links of a release counted from 1 within each source."""
    return links.where("not dead").withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def of_label(rows: DataFrame, column: str, label: str) -> DataFrame:
    """Rows of one label, or all rows for ``all``."""
    return rows if label == "all" else rows.where(F.col(column) == label)


def errors_only(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("ok"))


def sorted_page(rows: DataFrame, order: str, date: str, title: str, key: str, page: int = 1, size: int = 120) -> DataFrame:
    """The first ``page`` pages in an order: newest, oldest or title; ties by key."""
    by = {"newest": [F.desc_nulls_last(date)], "oldest": [F.asc_nulls_last(date)], "title": [F.asc(F.lower(title))]}[order]
    return rows.orderBy(*by, F.asc(key)).limit(page * size)


def feed_order(feeds: DataFrame, source: str = "source_id", label: str = "label_id") -> DataFrame:
    return feeds.orderBy(source, label)


def observation_order() -> list[Column]:
    return [F.asc("provider"), F.asc("label"), F.asc("record")]


def samples(rows: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The first few rows of each key in order, with ``n``, how many it has; a limit per group, and no key is gathered."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*observation_order()))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth").join(counts, key)


def winner_split(winners: DataFrame, first: str, second: str) -> DataFrame:
    """One row: winners by the rung that found them; whatever is neither second nor fallback is the first's."""
    rung = F.coalesce(F.col("rung"), F.lit(first))
    return winners.agg(F.count_if(~rung.isin(second, "fallback")).alias(f"winner_{first}"), F.count_if(rung == second).alias(f"winner_{second}"), F.count_if(rung == "fallback").alias("winner_fallback"))
