"""Dates, clocks, durations, counts, HTML and JSON as Column functions."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def calendar_date(text: Column) -> Column:
    """A real calendar date written YYYY-MM-DD; null for month 19 or 30 February."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parsed_timestamp(text: Column) -> Column:
    """The instant that a text names: UTC without a zone, dates as midnight, offsets honoured; null if unreadable.

    Each form is completed to one with a zone first, so the session's own never counts.
    """
    text = F.trim(text)
    zoneless = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.concat(text, F.lit("Z")))
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})$"), F.regexp_replace(F.regexp_replace(text, "z$", "Z"), r"([+-]\d{2})(\d{2})$", "$1:$2"))
    whole = F.coalesce(zoneless, zoned)
    return F.regexp_replace(whole, r"^(.{10}[T ]\d{2}:\d{2})(?!:)", "$1:00").try_cast("timestamp")


def iso_utc(ts: Column) -> Column:
    """The instant in UTC to the millisecond, whatever the session's zone."""
    millis = F.unix_millis(ts)
    day, rest = F.floor(millis / 86_400_000), F.pmod(millis, F.lit(86_400_000))
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(rest / 3_600_000)), two(F.floor(rest / 60_000) % 60), two(F.floor(rest / 1_000) % 60))
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), clock, F.lit("."), F.lpad((rest % 1_000).cast("string"), 3, "0"), F.lit("Z"))


def clock_seconds(text: Column) -> Column:
    """M:SS or H:MM:SS with seconds and minutes under 60; null if not or if nothing."""
    short, long = r"^(\d+):([0-5]\d)$", r"^(\d+):([0-5]\d):([0-5]\d)$"
    total = F.coalesce(
        found(text, short).try_cast("long") * 60 + found(text, short, 2).try_cast("long"),
        found(text, long).try_cast("long") * 3600 + found(text, long, 2).try_cast("long") * 60 + found(text, long, 3).try_cast("long"),
    )
    return F.when(total > 0, total)


def clock_seconds_lenient(text: Column) -> Column:
    """Two or three numbers folded to base 60."""
    folded = F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.try_cast("long"))
    return F.when(text.rlike(r"^\d+(:\d+){1,2}$"), folded)


#: Seconds of a unit, and the names that texts give it.
UNIT_SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}
UNIT_NAMES = {"h": ("hours", "hour", "hrs", "hr", "h"), "m": ("minutes", "minute", "mins", "min", "m"), "s": ("seconds", "second", "secs", "sec", "s")}


def amounts(text: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """Map of units to the first number that stands before one of their names."""
    pairs = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?\s*[a-z]+)(?![a-z0-9_])"), 1)
    number, name = (lambda x: F.regexp_extract(x, "^[0-9.]+", 0).cast("double")), (lambda x: F.regexp_extract(x, "[a-z]+$", 0))
    first = lambda own: F.try_element_at(F.filter(pairs, lambda x: name(x).isin(*own)), F.lit(1))
    return F.create_map(*(c for unit, own in names.items() for c in (F.lit(unit), number(first(own)))))


def seconds_of(amounts: Column) -> Column:
    return sum((F.coalesce(F.try_element_at(amounts, F.lit(unit)), F.lit(0.0)) * n for unit, n in UNIT_SECONDS.items()), F.lit(0.0))


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO 8601 duration, a clock, a number, or words such as 1h 20m; rounded, null if not positive."""
    low = F.lower(F.trim(text))
    # P, days, T, then hours, minutes and seconds, each at most once and in this order
    days, clock = F.regexp_extract(low, "^p([^t]*)t", 1), F.regexp_extract(low, "^p[^t]*t(.*)$", 1)
    well = lambda part, units: F.regexp_replace(part, r"[0-9]+(\.[0-9]+)?(?=[a-z])", "").isin(*units)
    iso = low.rlike("^p[^t]*t") & well(days, ("", "d")) & well(clock, ("", "h", "m", "s", "hm", "hs", "ms", "hms"))
    spaced = F.regexp_replace(F.concat(days, clock), "([a-z])", "$1 ")
    parts = F.split(low, ":")
    shaped = F.forall(parts, lambda x: x.rlike("^[0-9]+$")) & (F.length(F.element_at(parts, -1)) == 2) & (F.length(F.element_at(parts, -2)) <= 2)
    on_clock = F.size(parts).between(2, 3) & F.when(F.size(parts) >= 2, shaped)
    total = (
        F.when(iso, seconds_of(amounts(spaced, {unit: (unit,) for unit in UNIT_SECONDS})))
        .when(on_clock, clock_seconds_lenient(low).cast("double"))
        .when(low.rlike(r"^[0-9]+(\.[0-9]+)?$"), low.try_cast("double"))
        .otherwise(seconds_of(amounts(low, UNIT_NAMES)))
    )
    return F.when(total > 0, F.round(total).cast("long"))


def prefixed_date(text: Column) -> Column:
    """The date behind a ``!Date:`` mark, or the text itself."""
    return F.coalesce(found(text, r"^!Date:\s*(.+)$"), text)


def positive_number(text: Column) -> Column:
    value = F.round(text.try_cast("double")).cast("long")
    return F.when(value > 0, value)


def view_count(text: Column) -> Column:
    """Views from 1,234 views, 12k or 1.2M; null if unreadable."""
    plain = F.lower(F.regexp_replace(text, r"[,\s]", ""))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)(k|m|views?)?$"
    scale = F.create_map(F.lit("k"), F.lit(1_000), F.lit("m"), F.lit(1_000_000))
    return F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, 1).try_cast("double") * F.coalesce(F.try_element_at(scale, F.regexp_extract(plain, pattern, 2)), F.lit(1)))


def elapsed_text(seconds: Column) -> Column:
    return F.when(seconds >= 60, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("int").cast("string"), F.lit("s"))).otherwise(F.concat(seconds.cast("int").cast("string"), F.lit("s")))


def percent(part: Column, whole: Column) -> Column:
    """Rounded percent between 0 and 100, null without a whole."""
    return F.when(whole > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.round(100.0 * part / whole).cast("int"))))


def distinct_names(names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def split_names(text: Column) -> Column:
    return distinct_names(F.split(F.coalesce(text, F.lit("")), r"(?i),|\s+(?:and|&)\s+"))


#: References that names are written with, decoded in this order.
NAME_REFERENCES = (("&amp;", "&"), ("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))


def listed_names(value: Column) -> Column:
    """Names of a JSON value: a text, an object's ``name``, or a list of either; texts are split, references decoded."""
    own = F.try_parse_json(value)
    of = lambda x, kind: F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))
    entries = F.when(of(own, "ARRAY"), F.try_variant_get(own, "$", "array<variant>")).otherwise(F.array(own))
    none = F.array().cast("array<string>")

    def names(x: Column) -> Column:
        name = F.try_variant_get(x, "$.name", "string")
        return F.when(of(x, "STRING"), F.split(F.try_variant_get(x, "$", "string"), r"(?i),|\s+(?:and|&)\s+")).when(of(x, "OBJECT") & name.isNotNull(), F.array(name)).otherwise(none)

    def clean(x: Column) -> Column:
        for reference, char in NAME_REFERENCES:
            x = F.regexp_replace(x, f"(?i){reference}", char)
        return x

    return distinct_names(F.transform(F.flatten(F.transform(F.filter(entries, lambda x: x.isNotNull()), names)), clean))


def absolute_url(path: Column, base: str) -> Column:
    return F.when(path.rlike("(?i)^https?://"), path).when(path.startswith("//"), F.concat(F.lit("https:"), path)).when(path.startswith("/"), F.concat(F.lit(base), path))


@pandas_udf(StringType())
def _references(values: pd.Series) -> pd.Series:
    """Numeric character references; those that name no character vanish."""

    def one(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return "" if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)

    return values.map(lambda x: None if x is None else re.sub(r"&#(?:(\d+)|[xX]([0-9a-fA-F]+));", one, x))


def html_text(page: Column) -> Column:
    """Text of an HTML fragment: no scripts, styles or tags, references decoded in a fixed order.

    &amp; is decoded before quotes and brackets, so text that was escaped twice is decoded twice.
    Only fragments with numeric references leave the JVM.
    """
    shown = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(shown, "<[^>]+>", " ")
    numeric = text.rlike("&#([0-9]+|[xX][0-9a-fA-F]+);")
    text = F.when(numeric, _references(F.when(numeric, text))).otherwise(text)
    text = F.regexp_replace(text, "(?i)&nbsp;", " ")
    for name, char in (("amp", "&"), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(text, "[\\s\u00a0\ufeff]+", " "))


def html_title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def without_comments(page: Column) -> Column:
    return F.regexp_replace(page, "(?s)<!--.*?-->", " ")


def html_heading(page: Column) -> Column:
    return html_text(F.regexp_extract(without_comments(page), r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))


def block_account(page: Column, mark: str = "vit-uploader", path: str = "profile") -> Column:
    """The account that the first list item of class ``mark`` links to; cards and menus elsewhere do not count."""
    block = F.regexp_extract(without_comments(page), rf"(?is)<li\b[^>]*\bclass=[\"'][^\"']*\b{mark}\b[^\"']*[\"'][^>]*>(.*?)</li>", 1)
    return found(block, rf"(?is)\bhref=[\"'][^\"']*/{path}/([\w.~-]+)/")


def page_seconds(page: Column) -> Column:
    """The page's own duration: og:duration of its first such tag, positive seconds."""
    value = try_key(meta_tags(without_comments(page)), "og:duration")
    return F.when(value.rlike("^[0-9]+$"), positive_number(value))


def try_key(values: Column, key: str) -> Column:
    return F.try_element_at(values, F.lit(key))


def filled_by_recipe(page: Column, host: Column, recipes: dict[str, dict[str, str]], known: dict[str, Column]) -> dict[str, Column]:
    """The fields in ``known``, blank ones filled by the pattern that the page's host has for them.

    ``recipes``: per host a pattern with one group for each field it can fill.  What is known stays.
    """
    out = {}
    for field, value in known.items():
        tries = [F.when(host == name, F.nullif(html_text(F.regexp_extract(page, fields[field], 1)), F.lit(""))) for name, fields in recipes.items() if field in fields]
        out[field] = F.coalesce(F.nullif(value, F.lit("")), *tries)
    return out


def meta_tags(page: Column) -> Column:
    """Map of meta names and properties to contents; the first of a name counts."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)
    pairs = F.transform(
        tags,
        lambda t: F.struct(
            F.lower(found(t, r"(?i)\b(?:name|property)\s*=\s*[\"']([^\"']+)[\"']")).alias("key"),
            found(t, r"(?i)\bcontent\s*=\s*[\"']([^\"']*)[\"']").alias("value"),
        ),
    )
    pairs = F.filter(pairs, lambda x: x["key"].isNotNull() & x["value"].isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda x: x["key"] == k), 1)["value"]))


def attribute(tag: Column, name: str) -> Column:
    return found(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']")


def canonical_url(page: Column) -> Column:
    """The canonical link of a page, else its og:url; attributes in any order."""
    links = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)(<link\b[^>]*>)"), 1), lambda t: (F.lower(attribute(t, "rel")) == "canonical") & attribute(t, "href").isNotNull())
    return F.coalesce(attribute(F.try_element_at(links, F.lit(1)), "href"), try_key(meta_tags(page), "og:url"))


def related_ids(page: Column, pattern: str, most: int) -> Column:
    """Distinct ids of links in page order, at most ``most``."""
    return F.slice(F.array_distinct(F.regexp_extract_all(page, F.lit(pattern), 1)), 1, most)


def embedded_json(page: Column, attribute_name: str = "data-page") -> Column:
    """The JSON body of the first JSON script that carries an attribute: as it is, else with its entities
    decoded; null if neither parses."""
    scripts = F.regexp_extract_all(page, F.lit(r"(?is)(<script\b[^>]*>.*?</script>)"), 1)
    own = F.filter(scripts, lambda x: x.rlike(rf"(?is)^<script\b[^>]*\b{attribute_name}\s*=") & x.rlike(r"(?is)^<script\b[^>]*\btype=[\"']application/json[\"']"))
    raw = F.regexp_extract(F.try_element_at(own, F.lit(1)), r"(?is)^<script\b[^>]*>(.*)</script>$", 1)
    plain = raw
    for name, char in (("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.coalesce(F.when(F.try_parse_json(raw).isNotNull(), raw), F.when(F.try_parse_json(plain).isNotNull(), plain))


VIDEO = StructType([*(StructField(x, StringType()) for x in ("name", "description", "date_published", "duration", "url")), StructField("actors", ArrayType(StringType()))])


def json_ld(page: Column) -> Column:
    """First values of a video object found anywhere in a page's JSON-LD blocks; pages without one never leave the JVM."""
    some = page.rlike("(?i)application/ld\\+json")
    none = F.struct(*(F.array().cast(f.dataType).alias(f.name) if f.name == "actors" else F.lit(None).cast(f.dataType).alias(f.name) for f in VIDEO.fields))
    return F.when(some, _json_ld(F.when(some, page))).otherwise(none)


@pandas_udf(VIDEO)
def _json_ld(pages: pd.Series) -> pd.DataFrame:
    """The walk itself, in document order, which JSON objects lose as values inside the JVM."""
    fields = {"name": "name", "description": "description", "date_published": "datePublished", "duration": "duration", "url": "url"}

    def walk(node, out):
        if isinstance(node, list):
            for x in node:
                walk(x, out)
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if "VideoObject" in (kinds if isinstance(kinds, list) else [kinds]):
                for own, name in fields.items():
                    if out[own] is None and isinstance(node.get(name), (str, int, float)) and str(node[name]).strip():
                        out[own] = str(node[name]).strip()
                people = node.get("actor") or node.get("performer") or []
                if not out["actors"]:
                    for x in people if isinstance(people, list) else [people]:
                        name = x.get("name") if isinstance(x, dict) else x
                        if isinstance(name, str) and name.strip() and name.strip() not in out["actors"]:
                            out["actors"].append(name.strip())
            for x in node.values():
                walk(x, out)

    def one(page):
        out = {**dict.fromkeys(fields), "actors": []}
        for block in re.findall(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>", page or ""):
            for text in (block, html.unescape(block)):
                try:
                    walk(json.loads(text), out)
                    break
                except ValueError:
                    continue
        return out

    return pd.DataFrame([one(x) for x in pages], columns=[*fields, "actors"])
