"""Feeds landed as files: paged scans with their invariants, incremental snapshots, media joins, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions.parse import clock_seconds_lenient, embedded_json, found
from almanac.operators.dedupe import by_precedence, first_seen, last_write
from almanac.operators.staging import staged


def json_records(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Records of JSON files that hold an array, or an object with the array in ``field``."""
    rows = spark.read.schema(f"{field} array<struct<{schema}>>" if field else schema).option("multiLine", True).json(path)
    return rows.select(F.explode(field).alias("r")).select("r.*") if field else rows


class FeedError(ValueError):
    """A feed whose pages contradict each other or its request."""


def ensure(rows: DataFrame, problem: Column) -> DataFrame:
    """Fails with the first problem found; returns the rows."""
    bad = rows.select(problem.alias("problem")).where("problem is not null").limit(1).collect()
    if bad:
        raise FeedError(bad[0][0])
    return rows


def filter_applied(filtered: int, unfiltered: int) -> None:
    """A feed that returns as much with a filter as without ignored it."""
    if filtered == unfiltered:
        raise FeedError("the feed ignored its filter")


def page_problems(pages: DataFrame, by: list[str], most: int = 1000) -> DataFrame:
    """Per scan (``by``) its number of pages, and what contradicts that it is whole: 1 to the last page,
    each once, one last page, not too many; null if nothing does.  ``pages``: page, last_page."""
    facts = pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("page").alias("distinct"), F.min("page").alias("low"), F.max("page").alias("high"), F.min("last_page").alias("last_low"), F.max("last_page").alias("last_high"))
    problem = (
        F.when(F.col("last_low") != F.col("last_high"), "pages disagree about the last page")
        .when(F.col("last_high") > most, "too many pages")
        .when((F.col("pages") != F.col("distinct")) | (F.col("low") != 1) | (F.col("high") != F.col("last_high")) | (F.col("pages") != F.col("last_high")), "pages are missing or repeated")
    )
    return facts.select(*by, "pages", problem.alias("problem"))


def whole_pages(pages: DataFrame, most: int = 1000) -> DataFrame:
    """The pages of one scan, which fails unless it is whole (see page_problems)."""
    ensure(page_problems(pages, [], most), F.col("problem"))
    return pages


def until_window_edge(records: DataFrame, page: str, date: str, start: Column, size: int = 100) -> DataFrame:
    """Records up to the first page that is short or reaches behind the window, those in the window only."""
    pages = records.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("oldest"))
    end = pages.where((F.col("n") < size) | (F.col("oldest") < start)).agg(F.min(page).alias("end"))
    kept = records.join(F.broadcast(end), (F.col(page) <= F.col("end")) | F.col("end").isNull()).drop("end")
    return kept.where(F.col(date) >= start)


def with_all_tags(rows: DataFrame, tags: str, required: list[str]) -> DataFrame:
    fold = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return rows.where(F.size(F.array_except(F.array(*map(F.lit, required)), F.transform(tags, fold))) == 0)


def of_entity(rows: DataFrame, column: str, slug: str) -> DataFrame:
    return rows.where(F.lower(column) == slug.lower())


def embedded_records(pages: DataFrame, page: str, schema: str, path: str = "$.props.articles.data") -> DataFrame:
    """Records of the JSON that a page carries in an attribute; pages without it give none."""
    data = F.get_json_object(embedded_json(F.col(page)), path)
    rows = pages.withColumn("r", F.explode(F.from_json(data, f"array<struct<{schema}>>")))
    return rows.select(*(c for c in pages.columns if c != page), "r.*")


def distinct_records(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    return first_seen(rows, [key], ordinal)


def new_pages(listing: DataFrame, snapshot: DataFrame, page: str, key: str) -> DataFrame:
    """Records before the first page of which the snapshot knows every record."""
    known = listing.join(snapshot.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    stop = known.groupBy(page).agg(F.bool_and(F.col("_known").isNotNull()).alias("all")).where("all").agg(F.min(page).alias("stop"))
    return listing.join(F.broadcast(stop), F.col("stop").isNull() | (F.col(page) < F.col("stop"))).drop("stop")


def refreshed(snapshot: DataFrame, listing: DataFrame, page: str, key: str, full: bool) -> DataFrame:
    """The new snapshot: the whole listing in a full run, else new pages laid over the old records."""
    if full:
        return listing.drop(page).dropDuplicates([key])
    new = new_pages(listing, snapshot, page, key).drop(page).dropDuplicates([key])
    return new.unionByName(snapshot.join(new.select(key), key, "left_anti"))


def full_due(last_full: Column, now: Column, days: int = 7) -> Column:
    """Whether the whole listing is due: never read, or ``days`` ago."""
    return last_full.isNull() | (now >= last_full + F.make_dt_interval(F.lit(days)))


def refreshed_when_due(snapshot: DataFrame, listing: DataFrame, page: str, key: str, last_full: Column, now: Column) -> tuple[DataFrame, bool]:
    """(new snapshot, whether the listing was read as a whole); a whole reading drops what the listing lacks."""
    full = bool(snapshot.sparkSession.range(1).select(full_due(last_full, now)).first()[0])
    return refreshed(snapshot, listing, page, key, full), full


def category_scan(categories: DataFrame, key: str = "record", verdict: str = "decision", ordinal: str = "ordinal") -> DataFrame:
    """One verdict per record over all categories: review beats admission, whichever came first."""
    return by_precedence(categories, [key], verdict, {"review": 0, "admit": 1, "excluded": 2}, ordinal)


def posts_with_media(posts: DataFrame, media: DataFrame) -> DataFrame:
    """Posts with their attached media that are free, accessible videos."""
    own = posts.withColumn("media_id", F.explode("attachments")).drop("attachments")
    return own.join(media.where("kind = 'video' and accessible and coalesce(price, 0) = 0"), "media_id")


def cards(pages: DataFrame, page: str, marker: str = "<article") -> DataFrame:
    """Cards of listing pages: id, title, seconds, views; cards without a clock are dropped."""
    part = F.explode(F.slice(F.split(page, marker), 2, 1 << 20))
    rows = pages.withColumn("card", part)
    clock = found(F.col("card"), r"(\d+(?::\d{2}){1,2})")
    out = rows.select(*(c for c in pages.columns if c != page), found(F.col("card"), r"href=[\"'][^\"']*/([A-Za-z0-9]+)[\"']").alias("id"), F.trim(found(F.col("card"), r"title=[\"']([^\"']*)[\"']")).alias("title"), clock_seconds_lenient(clock).alias("seconds"), found(F.col("card"), r"([0-9][0-9.,]*[kKmM]?)\s*views").alias("views"))
    return out.where("seconds is not null")


def labelled(rows: DataFrame, policy: str, umbrella: str | None = None) -> DataFrame:
    """Label policy: an umbrella label replaces all labels, split labels mark rows that have none."""
    if policy == "umbrella":
        return rows.withColumn("label_id", F.lit(umbrella))
    return rows.withColumn("label_identity_missing", F.col("label_id").isNull() | (F.col("label_id") == ""))


def verified_empty(results: DataFrame) -> DataFrame:
    """Per feed what its result means: failed where it is empty without proof or all invalid, else ok."""
    verdict = F.when((F.col("fetched") == 0) & ~F.col("verified_empty"), "empty without proof").when((F.col("fetched") > 0) & (F.col("valid") == 0), "all records invalid")
    return results.withColumn("error", F.coalesce(F.col("error"), verdict)).withColumn("ok", F.col("error").isNull())


def related_walk(starts: DataFrame, edges: DataFrame, *, bound: int, nodes: DataFrame | None = None, admits: Column | None = None) -> DataFrame:
    """(start, id, level, nth, admitted): what a walk over related records follows for each start.

    ``starts``: start, id, place, the records a walk begins with, in order.  ``edges``: id, related,
    place, related records in the order of their page.  A record is admitted if ``admits`` holds over
    start and the columns of ``nodes`` (id and more); a record that ``nodes`` lacks is not, and without
    ``admits`` all are.  Admitted records alone are asked for related ones.

    A start follows ``bound`` records at most, in the order in which pages name them, level by level;
    what was followed before is neither followed nor named again.  The places left are shared in that
    order too: a page of which only a part fits gives its first ones, and a name that turns out to
    have been followed frees its place for later pages.  Level 0 are the starts themselves, which
    count as followed if admitted.

    One round a level.  All steps inside a level follow from sums and minima over its order: the
    places left after each page are max(left - named, 0), a running sum reflected at zero.
    """
    entry, every = Window.partitionBy("start", "pos"), Window.partitionBy("start").orderBy("pos")
    starts = staged(first_seen(starts, ["start", "id"], "place"), "starts")
    held = starts.groupBy("start").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # no page needs more of its names than there are places and records followed
    named = first_seen(edges, ["id", "related"], "place").withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("place", "related")))
    named = staged(named.where(F.col("_nth") <= 2 * bound + held).select("id", "related", F.col("_nth").alias("place")), "named")

    def judged(rows: DataFrame) -> DataFrame:
        if admits is None:
            return rows.withColumn("admitted", F.lit(True))
        known = rows.join(nodes.withColumn("_known", F.lit(True)), "id", "left")
        return known.withColumn("admitted", F.coalesce(F.col("_known") & admits, F.lit(False))).select(*rows.columns, "admitted")

    def expanded(level: DataFrame, walked: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(next level, places left) after the entries of ``level`` (start, pos, id, new, admitted)."""
        asking = level.where("new and admitted").select("start", "pos", "id")
        before = walked.select("start", F.col("id").alias("related"), F.col("pos").alias("_at"))
        found = asking.join(named, "id").where("related != id").select("start", "pos", "related", "place").join(before, ["start", "related"], "left")
        fresh = found.where("_at is null or _at > pos").withColumn("rank", F.row_number().over(entry.orderBy("place"))).where(F.col("rank") <= bound)
        fresh = staged(fresh.select("start", "pos", "related", "rank"), "fresh")
        change = level.join(fresh.groupBy("start", "pos").agg(F.count(F.lit(1)).alias("k")), ["start", "pos"], "left").join(left, "start")
        sums = change.withColumn("sum", F.col("left") + F.sum(F.when(F.col("new"), -F.coalesce("k", F.lit(0))).otherwise(1)).over(every))
        after = sums.withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(every)))
        spans = staged(after.select("start", "pos", "after", F.coalesce(F.lag("after").over(every), "left").alias("free")), "places")
        taken = fresh.join(spans, ["start", "pos"]).where("rank <= free")
        onward = Window.partitionBy("start").orderBy("pos", "rank")
        rest = left.join(spans.groupBy("start").agg(F.max_by("after", "pos").alias("after")), "start", "left").select("start", F.coalesce("after", "left").alias("left"))
        return taken.select("start", F.col("related").alias("id"), F.row_number().over(onward).alias("pos")), rest

    roots = judged(starts.withColumn("pos", F.row_number().over(Window.partitionBy("start").orderBy("place", "id"))).select("start", "id", "pos"))
    roots = staged(roots.withColumns({"new": F.lit(True), "level": F.lit(0)}), "level")
    left = staged(starts.select("start").distinct().withColumn("left", F.lit(bound).cast("long")), "left")
    # a start excludes itself alone, so nothing counts as followed yet
    queue, left = expanded(roots, roots.where("false"), left)
    levels, walked, n = [roots], roots.where("admitted").select("start", "id", F.lit(0).alias("pos")), 0
    while True:
        n, queue, left = n + 1, staged(queue, "queue"), staged(left, "left")
        if queue.isEmpty():
            break
        own = Window.partitionBy("start", "id").orderBy("pos")
        seen = queue.withColumn("_nth", F.row_number().over(own)).join(walked.select("start", "id", F.lit(True).alias("_old")), ["start", "id"], "left")
        level = staged(judged(seen.select("start", "id", "pos", (F.col("_old").isNull() & (F.col("_nth") == 1)).alias("new"))).withColumn("level", F.lit(n)), "level")
        new = level.where("new").select("start", "id", "pos")
        queue, left = expanded(level, walked.unionByName(new), left)
        walked = staged(walked.unionByName(new.withColumn("pos", F.lit(0))), "walked")
        levels.append(level.where("new"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("start", F.col("level") > 0).orderBy("level", "pos")
    return out.select("start", "id", "level", F.row_number().over(order).alias("nth"), "admitted")


def hydrated(found: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with their details; one without details is left out."""
    return found.join(details, key)


def csv_safe(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*(csv_safe(F.col(c)).alias(c) for c in rows.columns)).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def page_gaps(rows: DataFrame, page: str) -> DataFrame:
    """Pages whose predecessor is missing, but for the first one; an equi-join of distinct pages."""
    pages = rows.select(F.col(page).alias("_page")).distinct()
    low = pages.agg(F.min("_page").alias("_low"))
    gaps = pages.join(pages.select((F.col("_page") + 1).alias("_page")), "_page", "left_anti")
    return gaps.join(F.broadcast(low), F.col("_page") != F.col("_low")).select(F.col("_page").alias(page))


def whole_cursors(pages: DataFrame, most: int = 1000) -> DataFrame:
    """Pages (cursor, next_cursor) of one walk: from the first one, which none names, over all of them to the end.

    Not too many, no cursor twice, none that leads back or nowhere.  At most ``most`` pairs reach the driver.
    """
    walk = pages.select("cursor", "next_cursor").limit(most + 1).collect()
    following = dict(map(tuple, walk))
    if len(walk) > most:
        raise FeedError("too many pages")
    if len(following) < len(walk):
        raise FeedError("a cursor is repeated")
    first = [x for x in following if x not in set(following.values())]
    if walk and len(first) != 1:
        raise FeedError("the walk has no beginning, or several")
    at, steps = (first or [None])[0], 0
    while at in following:
        at, steps = following[at], steps + 1
    if at is not None or steps != len(walk):
        raise FeedError("the walk does not reach all pages, or does not end")
    return pages


def ingest_window(rows: DataFrame, date: str, start: Column, now: Column) -> DataFrame:
    """Records with a readable date from ``start`` to this instant."""
    at = F.try_to_timestamp(F.col(date).cast("string"))
    return rows.where((at >= start) & (at <= now))


def search_union(results: DataFrame, answers: DataFrame, key: str = "url", ordinal: str = "ordinal") -> DataFrame:
    """Candidates of all queries that succeeded, each address once; fails if every query failed.

    ``results``: query, ok, error; ``answers``: query, ``key`` and more.
    """
    facts = results.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"))
    ensure(facts, F.when((F.col("n") > 0) & (F.col("good") == 0), "all queries failed"))
    return last_write(answers.join(results.where("ok").select("query"), "query", "left_semi"), [key], ordinal)


def registry(feeds: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Feeds with their merge priority, their place in the list from 0; a small table by nature."""
    return feeds.withColumn("priority", F.row_number().over(Window.orderBy(ordinal)) - 1)


def with_priority(rows: DataFrame, feeds: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows with their feed's priority; rows of feeds that are not listed come last."""
    return rows.join(feeds.select(source, "priority"), source, "left").withColumn("priority", F.coalesce("priority", F.lit((1 << 31) - 1)))
