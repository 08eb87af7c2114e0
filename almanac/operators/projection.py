"""What a feed's record becomes as a release of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.reconcile import release_id

#: Columns of a record, and what a release has where a record says nothing (None: nothing either).
RECORD = {
    "title": ("string", None),
    "contributors": ("array<string>", None),
    "released": ("date", None),
    "duration": ("bigint", None),
    "duration_min": ("bigint", None),
    "duration_max": ("bigint", None),
    "duration_review": ("boolean", False),
    "poster_url": ("string", ""),
    "tags": ("array<string>", []),
    "release_url": ("string", None),
    "code": ("string", None),
    "metadata_poor": ("boolean", False),
    "label_identity_missing": ("boolean", False),
    "field_provenance": ("map<string,string>", {}),
}
#: Columns of a release that matching owns: a new record never touches them.
OWNED = {"links": ("array<string>", []), "dead_links": ("array<string>", []), "checked_at": ("timestamp", None), "matching": ("string", None), "metadata_checked_at": ("timestamp", None)}


def standing(kind: str, default) -> Column:
    if default == [] or default == {}:
        return (F.array() if default == [] else F.create_map()).cast(kind)
    return F.lit(default).cast(kind)


def given(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def releases_of(records: DataFrame, feeds: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """A release for each record: ids and names from its feed, its own fields or their defaults, what
    matching owns from the release as it was, and one entry of provenance.

    ``records``: source_id, record_id and any of RECORD, label_id, label, source, source_url,
    record_url, metadata_checked_at.  ``feeds``: source_id, name.  ``previous``: release_id and any of
    OWNED.  A record of an unknown feed goes by the feed's id.  A blank address or code is none.
    """
    named = records.join(feeds.select("source_id", F.col("name").alias("_feed")), "source_id", "left")
    feed = F.coalesce("_feed", F.col("source_id").cast("string"))
    text = lambda name: given(records, name, "string")
    own = {name: F.coalesce(given(records, name, kind), standing(kind, default)) for name, (kind, default) in RECORD.items()}
    own |= {name: F.nullif(own[name], F.lit("")) for name in ("release_url", "code")}
    source = F.coalesce(text("source"), feed)
    entry = F.struct(source.alias("source"), now.alias("fetched_at"), F.nullif(text("source_url"), F.lit("")).alias("source_url"), F.nullif(text("record_url"), F.lit("")).alias("record_url"), text("record_id").alias("record_id"))
    fresh = given(records, "metadata_checked_at", "timestamp").alias("_metadata_at")
    rows = named.select(
        release_id(F.col("source_id").cast("string"), text("label_id"), text("record_id")).alias("release_id"),
        F.col("source_id"),
        source.alias("source"),
        F.coalesce(text("label_id"), F.col("source_id").cast("string")).alias("label_id"),
        F.coalesce(text("label"), feed).alias("label"),
        *(c.alias(name) for name, c in own.items()),
        F.array(entry).alias("provenance"),
        fresh,
    )
    kept = previous.select("release_id", *(given(previous, name, kind).alias(name) for name, (kind, _) in OWNED.items()))
    both = rows.join(kept, "release_id", "left")
    carried = {name: F.coalesce(F.col(name), standing(kind, default)) for name, (kind, default) in OWNED.items()}
    carried["metadata_checked_at"] = F.coalesce("_metadata_at", "metadata_checked_at")
    return both.select(*(c for c in rows.columns if c != "_metadata_at"), *(c.alias(name) for name, c in carried.items()))
