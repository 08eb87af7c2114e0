"""Rule lists, decision cascades and classes of errors and outcomes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions.text import snippet


def hits(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Distinct labels of the rules (label, regular expression) that a text matches, in order."""
    found = F.array_compact(F.array(*(F.when(text.rlike(rule), F.lit(label)) for label, rule in rules))) if rules else F.array()
    return F.array_distinct(found.cast("array<string>"))


@dataclass(frozen=True)
class Cascade:
    """Rules of one decision: ``safety`` comes first and cannot be left out."""

    safety: list[tuple[str, str]]
    positive: list[tuple[str, str]]
    review: list[tuple[str, str]] = field(default_factory=list)
    exclude: list[tuple[str, str]] = field(default_factory=list)
    strong: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        if not self.safety:
            raise ValueError("a cascade needs its safety rules")


def decided(text: Column, rules: Cascade) -> Column:
    """Struct of decision (excluded, review, admit), reason, keywords and snippet.

    Order: safety, no evidence, exclusion, review, no strong evidence, admission.
    """
    blocked, positive, review, exclude, strong = (hits(text, x) for x in (rules.safety, rules.positive, rules.review, rules.exclude, rules.strong))
    evidence = F.array_distinct(F.concat(positive, review))
    out = lambda decision, reason, keywords: F.struct(F.lit(decision).alias("decision"), reason.alias("reason"), keywords.alias("keywords"), snippet(text, F.when(F.size(blocked) > 0, blocked).when(F.size(evidence) > 0, evidence).otherwise(exclude)).alias("snippet"))
    none = F.array().cast("array<string>")
    return (
        F.when(F.size(blocked) > 0, out("excluded", F.lit("safety"), blocked))
        .when(F.size(evidence) == 0, out("excluded", F.lit("no evidence"), none))
        .when(F.size(exclude) > 0, out("excluded", F.array_join(exclude, ","), evidence))
        .when(F.size(review) > 0, out("review", F.lit("review"), evidence))
        .when(F.size(strong) == 0, out("excluded", F.lit("no strong evidence"), evidence))
        .otherwise(out("admit", F.lit(None).cast("string"), evidence))
    )


def verdict_audit(verdict: Column) -> Column:
    """A verdict as the audit map that provenance keeps."""
    return F.create_map(F.lit("decision"), verdict["decision"], F.lit("reason"), F.coalesce(verdict["reason"], F.lit("")), F.lit("keywords"), F.array_join(verdict["keywords"], ","), F.lit("snippet"), verdict["snippet"])


#: Phrases of a refusal; pairs of what is said first and what follows in the same sentence,
#: each with how a word must agree (its end, its whole with or without a plural s, its beginning).
ACCESS, LACKING = ("key", "token", "secret", "credential"), ("missing", "required", "invalid", "expired", "absent")
REFUSALS = ("not configured", "unauthorized", "forbidden", "http 401", "http 403")
SETTINGS = ("env variable", "environment variable")
SENTENCES = ((("missing",), "end", ACCESS), (ACCESS, "whole", LACKING))


def error_class(error: Column) -> Column:
    """ok, unimplemented, config or failing.

    An error is one of configuration if it speaks of a refusal, of a setting of the environment, or of
    missing access in one sentence.
    """
    low = F.lower(error)
    words = lambda x: F.regexp_extract_all(x, F.lit("([a-z0-9_]+)"), 1)
    spoken = F.concat(F.lit(" "), F.array_join(words(low), " "))
    refused = F.exists(F.array(*map(F.lit, REFUSALS)), low.contains) | F.exists(F.array(*(F.lit(f" {x}") for x in SETTINGS)), spoken.contains)

    def follows(own: Column, first: tuple[str, ...], how: str, then: tuple[str, ...]) -> Column:
        ending = lambda w: F.exists(F.array(*map(F.lit, first)), w.endswith)
        whole = lambda w: F.regexp_replace(w, "s$", "").isin(*first)
        at = F.array_position(F.transform(own, ending if how == "end" else whole), True)
        return (at > 0) & F.exists(F.slice(own, (at + 1).cast("int"), F.size(own)), lambda w: F.exists(F.array(*map(F.lit, then)), w.startswith))

    def lacks(sentence: Column) -> Column:
        said = [follows(words(sentence), *rule) for rule in SENTENCES]
        return said[0] | said[1]

    config = refused | F.exists(F.split(low, "[.]"), lacks)
    return F.when(error.isNull() | (error == ""), "ok").when(F.array_contains(words(low), "implemented") & spoken.rlike(" not implemented( |$)"), "unimplemented").when(config, "config").otherwise("failing")


def card_state(error_kind: Column, releases: Column) -> Column:
    """What a health card shows: attention, waiting or healthy."""
    return F.when(error_kind.isin("failing", "config"), "attention").when((error_kind == "unimplemented") | (releases == 0), "waiting").otherwise("healthy")


def http_class(status: Column) -> Column:
    return F.when(status.isin(404, 410), "definitive").when(status.between(200, 299), "ok").otherwise("inconclusive")


def link_outcome(kind: Column, status: Column, content_type: Column, body: Column, record: Column) -> Column:
    """live, dead or inconclusive for a checked link to ``record``.

    A page answers by its status alone.  An API answers only with JSON: a challenge page with status
    200 says nothing, an empty list says that the record is gone, and only the record itself, alone or
    first in a list, under the id asked for, says that it is there.
    """
    api_json = content_type.isNull() | (content_type == "") | F.lower(content_type).contains("json")
    parsed = F.try_parse_json(body)
    listed = F.schema_of_variant(parsed).startswith("ARRAY")
    own = F.when(listed, F.try_variant_get(parsed, "$[0].id", "variant")).otherwise(F.try_variant_get(parsed, "$.id", "variant"))
    same = (F.schema_of_variant(own) == "STRING") & (F.try_variant_get(own, "$", "string") == record)
    page = F.when(status.isin(404, 410), "dead").when(status.between(200, 299), "live").otherwise("inconclusive")
    silent = ~status.between(200, 299) | ~api_json | parsed.isNull()
    api = F.when(silent, "inconclusive").when(F.regexp_replace(body, r"\s", "") == "[]", "dead").when(same, "live").otherwise("inconclusive")
    return F.when(status.isNull(), "inconclusive").when(kind == "page", page).otherwise(api)


def confidence(tier: Column, fallback: Column) -> Column:
    return F.when(tier.isNull() | (tier == 0) | fallback, "low").otherwise("high")


def playback_status(live: Column, level: Column) -> Column:
    return F.when(live == 0, "Missing").when(level == "low", "Guessed").otherwise("Matched")
