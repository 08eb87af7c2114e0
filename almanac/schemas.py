"""Table schemas (as DDL) and boundary validation with quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELEASES = (
    "id string not null, source_id string not null, source string not null, label_id string not null, label string, "
    "title string not null, contributors array<string>, release_date date not null, duration_sec int, "
    "duration_range struct<min_sec: int, max_sec: int>, duration_review boolean, thumbnail_url string, release_url string, "
    "store_id string, launch_ts timestamp, preview_url string, price struct<regular: string, on_sale: boolean, free: boolean>, "
    "label_code string, tags array<string>, "
    "provenance array<struct<source: string, fetched_at: timestamp, source_url: string, record_url: string, source_record_id: string, audit: map<string, string>>>, "
    "field_provenance map<string, string>, metadata_poor boolean, label_identity_missing boolean, "
    "live_links array<struct<source: string, url: string, verified_at: timestamp, verify_failures: int, part: int>>, "
    "dead_links array<struct<source: string, url: string, dead_at: timestamp, dead_reason: string>>, "
    "label_metadata_checked_at timestamp, checked_at timestamp, "
    "matching struct<lane: string, matched_at: timestamp, rule: string, confidence: string>"
)
OBSERVATIONS = "provider_id string not null, label_id string not null, record_id string not null, release_id string, label string, record string, fetched_at timestamp"
LINKS = "release_id string not null, kind string not null, source string not null, url string not null, verified_at timestamp, verify_failures int, dead_at timestamp, dead_reason string, part int"
FEEDS = "source_id string not null, label_id string not null, label string, priority int, ok boolean, last_success_at timestamp, last_error string, releases long, live long"
RUNS = "run_id string not null, kind string, started_at timestamp, finished_at timestamp, ok boolean, error string, outcomes array<struct<source_id: string, label_id: string, ok: boolean, error: string, accepted: int>>"
SNAPSHOTS = "source_id string not null, saved_at timestamp, state string"

#: Rules of a release record; a rule that is not true names the reason for quarantine.
RELEASE_RULES: dict[str, str] = {
    "id is blank": "length(id) > 0",
    "title is blank": "length(title) > 0",
    "label is blank": "length(label_id) > 0",
    "release date is no calendar date": "try_to_date(cast(release_date as string), 'yyyy-MM-dd') is not null",
    "duration is not positive": "duration_sec is null or duration_sec > 0",
    "duration range is upside down": "duration_range is null or duration_range.min_sec <= duration_range.max_sec",
    "price is no decimal": "price is null or price.regular is null or price.regular rlike '^[0-9]+([.][0-9]+)?$'",
    "url is not absolute": "release_url is null or try_parse_url(release_url, 'HOST') is not null",
    "provenance is empty": "size(provenance) > 0",
}


def problems(rules: dict[str, str]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def validated(rows: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their ``problems``): every row is in exactly one of both."""
    judged = rows.withColumn("problems", problems(rules))
    return judged.where("size(problems) = 0").drop("problems"), judged.where("size(problems) > 0")
