"""Entity resolution: clusters of observations, merged field by field with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.urls import url_identity


def present(value: Column, kind: str = "string") -> Column:
    """Neither null, nor an empty text or list."""
    return F.coalesce((F.size(value) > 0) if kind.startswith("array") else (value != "") if kind == "string" else value.isNotNull(), F.lit(False))


def release_id(source: Column, label: Column, record: Column) -> Column:
    return F.when(label.isNull() | (label == source), F.concat_ws(":", source, record)).otherwise(F.concat_ws(":", source, label, record))


def cluster_key(rows: DataFrame, *, url: str = "release_url", label: str = "label_id", native: str = "release_id", title_labels: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``cluster``: label and URL identity, else the native key; and ``titled`` and ``linked``.

    Labels in ``title_labels`` cluster by title without punctuation where there is a duration, and
    their records are ``titled``.  ``linked`` are records with a URL identity.
    """
    identity = url_identity(F.col(url))
    plain = F.regexp_replace(F.lower(F.col("title")), "[^a-z0-9]", "") if "title" in rows.columns else F.lit(None).cast("string")
    own = F.col(label).isin(*title_labels) if title_labels else F.lit(False)
    by_title = F.when(own & (F.col("duration") > 0) & (plain != ""), F.concat_ws("|", F.lit("title"), label, plain)) if title_labels else F.lit(None).cast("string")
    key = F.coalesce(by_title, F.when(identity.isNotNull(), F.concat_ws("|", F.lit("url"), label, identity)), F.concat_ws("|", F.lit("key"), native))
    return rows.withColumns({"cluster": key, "titled": F.coalesce(own, F.lit(False)), "linked": identity.isNotNull()})


def aliased(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Replaces ids by their canonical ones; ``aliases``: alias, canonical."""
    return rows.join(aliases.select(F.col("alias").alias(column), "canonical"), column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")


def merged(
    rows: DataFrame,
    fields: dict[str, str],
    *,
    key: str = "cluster",
    order: tuple[str, ...] = ("priority", "provider", "record"),
    priority: dict[str, list[str]] | None = None,
    duration: str | None = None,
    oldest: str | None = None,
    picks: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """One release per cluster out of its observations.

    ``fields`` maps names to types.  A field's value is that of the first observation that has one, by
    the field's providers in ``priority`` (others behind them, then by provider and record) or else by
    ``order``; ``<field>_from`` names its provider.  ``lead_provider`` and ``lead_record`` are the first
    observation by ``order``.

    The positive values of ``duration`` that agree are the duration; those that differ leave it null
    and give ``<duration>_min``, ``_max`` and ``_review`` (more than 1 apart), with all that measured it
    in ``<duration>_from``.  The date ``oldest`` is the oldest one where all observations are ``titled``
    and their durations agree.  ``picks`` adds (order, value) pairs: the value of the first row.

    ``observations`` and ``providers`` count what there is of either.  Two aggregates, by provider and then by
    cluster: no cluster is gathered, and lists hold one entry a provider.
    """
    first, names = F.struct(*order), list(fields)
    low = {"_lead": F.struct(first.alias("by"), F.struct("provider", "record").alias("value"))}
    for name, kind in fields.items():
        listed = (priority or {}).get(name)
        place = F.array_position(F.array(*map(F.lit, listed)), F.col("provider")) if listed else None
        by = first if place is None else F.struct(F.when(place > 0, place).otherwise(len(listed) + 1), "provider", "record")
        low[f"_of_{name}"] = F.when(present(F.col(name), kind), F.struct(by.alias("by"), F.col(name).alias("value"), F.col("provider").alias("who")))
    if oldest:
        low["_oldest"] = F.when(F.col(oldest).isNotNull(), F.struct(F.struct(F.col(oldest).alias("date"), first.alias("by")).alias("by"), F.col(oldest).alias("value"), F.col("provider").alias("who")))
    for name, (by, value) in (picks or {}).items():
        low[f"_pick_{name}"] = F.struct(by.alias("by"), value.alias("value"))
    measured = F.when(F.col(duration) > 0, F.col(duration)) if duration else F.lit(None)
    titled = F.col("titled") if "titled" in rows.columns else F.lit(False)
    one = rows.groupBy(key, "provider").agg(
        *(F.min(c).alias(name) for name, c in low.items()),
        F.count(F.lit(1)).alias("_n"),
        F.min(measured).alias("_low"),
        F.max(measured).alias("_high"),
        F.min(F.when(measured.isNotNull(), first)).alias("_first"),
        F.bool_and(titled).alias("titled"),
    )
    told = F.sort_array(F.collect_list(F.when(F.col("_first").isNotNull(), F.struct(F.col("_first").alias("by"), F.col("provider").alias("who")))))
    out = one.groupBy(key).agg(
        *(F.min(name).alias(name) for name in low),
        F.sum("_n").alias("observations"),
        F.count(F.lit(1)).alias("providers"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
        told.alias("_told"),
        F.bool_and("titled").alias("titled"),
    )
    agree, measured = F.col("_low") == F.col("_high"), F.col("_low").isNotNull()
    columns = []
    for name in names:
        value, who = F.col(f"_of_{name}.value"), F.col(f"_of_{name}.who")
        if name == duration:
            value = F.when(~measured, value).when(agree, F.col("_low"))
            who = F.when(measured & ~agree, F.array_join(F.col("_told.who"), ", ")).otherwise(who)
        elif name == oldest:
            old = F.col("titled") & F.coalesce(agree, F.lit(False))
            value, who = F.when(old, F.col("_oldest.value")).otherwise(value), F.when(old, F.col("_oldest.who")).otherwise(who)
        columns += [value.alias(name), who.alias(f"{name}_from")]
    if duration:
        range_of = {"min": F.when(~agree, F.col("_low")), "max": F.when(~agree, F.col("_high")), "review": F.when(~agree, F.col("_high") - F.col("_low") > 1)}
        columns += [c.alias(f"{duration}_{name}") for name, c in range_of.items()]
    lead = [F.col("_lead.value.provider").alias("lead_provider"), F.col("_lead.value.record").alias("lead_record")]
    return out.select(key, *columns, *lead, "observations", "providers", *(F.col(f"_pick_{name}.value").alias(name) for name in picks or {}))


def consensus(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One number where all agree, else their range, under review if they are more than 1 apart."""
    low, high = F.min(value), F.max(value)
    out = rows.where(F.col(value) > 0).groupBy(key).agg(low.alias("low"), high.alias("high"))
    same = F.col("low") == F.col("high")
    return out.select(key, F.when(same, F.col("low")).alias("value"), F.when(~same, F.col("low")).alias("min_value"), F.when(~same, F.col("high")).alias("max_value"), (F.col("high") - F.col("low") > 1).alias("review"))


def canonical_order() -> Column:
    """Which release of a cluster stays: an established one, then most live links, best feed, smallest id."""
    return F.struct((~F.col("established")).alias("a"), (-F.col("live")).alias("b"), F.col("priority").alias("c"), F.col("release_id").alias("d"))


def merged_history(links: DataFrame, key: str = "cluster") -> DataFrame:
    """Links of a cluster by address: an address that died anywhere is dead everywhere.

    ``links``: key, url, dead (boolean), checked_at.  Returns counts and the earliest check.
    """
    urls = links.groupBy(key, "url").agg(F.max("dead").alias("dead"), F.min("checked_at").alias("checked_at"))
    return urls.groupBy(key).agg(F.count_if(~F.col("dead")).alias("live"), F.count_if("dead").alias("tombstones"), F.min("checked_at").alias("checked_at"))


def history_links(links: DataFrame, key: str = "cluster") -> DataFrame:
    """One row per cluster and address: dead anywhere is dead everywhere, earliest check, first matching.

    ``links``: key, url, dead, checked_at, matching, ordinal.
    """
    return links.groupBy(key, "url").agg(F.max("dead").alias("dead"), F.min("checked_at").alias("checked_at"), F.min_by("matching", F.when(F.col("matching").isNotNull(), F.col("ordinal"))).alias("matching"))


def reconciled(rows: DataFrame, fields: dict[str, str], **how) -> tuple[DataFrame, DataFrame]:
    """(releases by canonical id, id map old -> canonical) of all clusters that may merge (see merged for ``how``).

    A single observation is a release, and clusters by URL merge as they are.  Of clusters by title or
    with an observation without a URL only those merge that have two providers or more, each once: the
    others stay as they are and are in neither.  ``rows`` may say ``titled`` and ``linked``; without
    ``linked`` no observation has a URL.
    """
    loose = F.lit(True) if "linked" not in rows.columns else ~F.col("linked") | (F.col("titled") if "titled" in rows.columns else F.lit(False))
    firsts = {"canonical_id": (canonical_order(), F.col("release_id")), "_linked": (F.struct((~loose).alias("a")), ~loose)}
    out = merged(rows, fields, picks=firsts, **how).where("observations = 1 or _linked or (providers >= 2 and observations = providers)").drop("_linked")
    ids = rows.select("cluster", "release_id").distinct().join(out.select("cluster", "canonical_id"), "cluster")
    return out, ids.select("release_id", "canonical_id")


def reconciled_store(rows: DataFrame, links: DataFrame, fields: dict[str, str], **how) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(releases, observations, links, deleted ids) of a store after all clusters that may merge are merged.

    A merged release replaces the canonical one; observations and links of the others move to it,
    links by the rule of their history; the others' ids are deleted.  What may not merge is in
    observations and links as it was.
    """
    merged_rows, ids = reconciled(rows, fields, **how)
    moves = ids.where("release_id != canonical_id")
    releases = merged_rows.withColumn("release_id", F.col("canonical_id")).drop("canonical_id")
    own = ids.select("release_id", "canonical_id")
    moved = lambda x: x.join(own, "release_id", "left").withColumn("release_id", F.coalesce("canonical_id", "release_id")).drop("canonical_id")
    return releases, moved(rows), history_links(moved(links), "release_id"), moves.select("release_id").distinct()
