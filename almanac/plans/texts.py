"""Text queries: identity and merging over pages and documents, parsing, classification, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import classify, parse, text, urls
from almanac.operators import coverage, matching, readmodel, reconcile
from almanac.operators.staging import staged
from almanac.plans.registry import query, tables
from almanac.sources import feeds


def variants(spark, sf_dir) -> DataFrame:
    """Pages under their own address and under five other spellings of it."""
    (pages,) = tables(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "#.*$", "")
    known = F.regexp_replace(bare, "^(https)://([^/?#]+)", "$1://user:word@$2:443")
    around = F.regexp_replace(bare, "^([a-z]+://[^/?#]+)", "$1/x/y/./../%2e%2e")
    forms = F.array(F.col("url"), F.concat(bare, F.lit("#part")), F.regexp_replace(bare, "^https?:", "http:"), F.upper(bare), known, around)
    return pages.select("page_id", F.posexplode(forms).alias("form", "release_url"))


#: Forms 4 and 5 name a user, the usual port, and segments that lead back: for SQL they are the bare address.
VARIANTS = """SELECT page_id, unnest([0, 1, 2, 3, 4, 5]) AS form, unnest([url, regexp_replace(url, '#.*$', '') || '#part', regexp_replace(regexp_replace(url, '#.*$', ''), '^https?:', 'http:'), upper(regexp_replace(url, '#.*$', '')), regexp_replace(url, '#.*$', ''), regexp_replace(url, '#.*$', '')]) AS release_url FROM pages"""
IDENTITY = r"""SELECT page_id, form, lower(h || CASE WHEN ahead != '' THEN ahead || regexp_replace(slug, '[^A-Za-z0-9]', '', 'g') || substr(p, length(ahead) + length(slug) + 1) ELSE p END || CASE WHEN q = '?' THEN '' ELSE q END) AS identity FROM (
SELECT *, regexp_extract(p, '^(/(?:[^/]*[^0-9/][^/]*/)*[0-9]+/)([^/]*)', 1) AS ahead, regexp_extract(p, '^(/(?:[^/]*[^0-9/][^/]*/)*[0-9]+/)([^/]*)', 2) AS slug FROM (
SELECT page_id, form, regexp_extract(release_url, '^[A-Za-z]+://([^/?#]+)', 1) AS h, regexp_replace(regexp_extract(release_url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS p,
regexp_extract(release_url, '(\?[^#]*)', 1) AS q FROM (""" + VARIANTS + ")))"


@query(IDENTITY)
def url_identity(spark, sf_dir):
    return variants(spark, sf_dir).select("page_id", "form", urls.url_identity(F.col("release_url")).alias("identity"))


@query(f"SELECT identity AS cluster, count(*) AS n, min(page_id) AS first_page FROM ({IDENTITY}) GROUP BY 1")
def url_clusters(spark, sf_dir):
    rows = variants(spark, sf_dir).withColumns({"label_id": F.lit("all"), "release_id": F.concat_ws(":", "page_id", "form")})
    out = reconcile.cluster_key(rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))
    return out.withColumn("cluster", F.substring("cluster", len("url|all|") + 1, 1 << 20))


def observations(spark, sf_dir) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    return docs.select(F.md5(F.array_join(words, " ")).alias("cluster"), F.col("source").alias("provider"), F.col("doc_id").alias("record"), F.col("doc_id").cast("string").alias("release_id"), F.substring("source", 4, 9).cast("int").alias("priority"), F.nullif("lang", F.lit("en")).alias("lang"), F.col("n_chars").alias("duration"), (F.col("n_chars") > 2000).alias("established"), F.lit(0).alias("live"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("released"))


OBSERVATIONS = """SELECT md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS cluster, source AS provider, doc_id AS record, substr(source, 4)::INT AS priority, nullif(lang, 'en') AS lang, n_chars AS duration, n_chars > 2000 AS established, DATE '2024-01-01' + (doc_id % 40)::INT AS released, (substr(source, 4)::INT, source, doc_id) AS r FROM documents"""


LANG_FIRST = ["src3", "src1"]


@query(f"""WITH o AS ({OBSERVATIONS}), m AS (SELECT cluster, min(duration) FILTER (duration > 0) AS lo, max(duration) FILTER (duration > 0) AS hi FROM o GROUP BY 1 HAVING count(*) = 1 OR cluster >= '8' OR count(DISTINCT provider) >= 2 AND count(*) = count(DISTINCT provider)),
p AS (SELECT cluster, string_agg(provider, ', ' ORDER BY r) AS tellers FROM (SELECT cluster, provider, min(r) AS r FROM o WHERE duration > 0 GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT *, (CASE provider WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END, provider, record) AS first FROM o)
SELECT cluster, arg_min(lang, first) FILTER (lang IS NOT NULL) AS lang, arg_min(provider, first) FILTER (lang IS NOT NULL) AS lang_from,
CASE WHEN any_value(lo) IS NULL THEN arg_min(duration, r) WHEN any_value(lo) = any_value(hi) THEN any_value(lo) END AS duration, CASE WHEN any_value(lo) != any_value(hi) THEN any_value(tellers) ELSE arg_min(provider, r) END AS duration_from,
CASE WHEN any_value(lo) != any_value(hi) THEN any_value(lo) END AS duration_min, CASE WHEN any_value(lo) != any_value(hi) THEN any_value(hi) END AS duration_max, CASE WHEN any_value(lo) != any_value(hi) THEN any_value(hi) - any_value(lo) > 1 END AS duration_review,
strftime(CASE WHEN cluster < '8' AND any_value(lo) = any_value(hi) THEN min(released) ELSE arg_min(released, r) END, '%Y-%m-%d') AS released, CASE WHEN cluster < '8' AND any_value(lo) = any_value(hi) THEN arg_min(provider, (released, r)) ELSE arg_min(provider, r) END AS released_from,
arg_min(provider, r) AS lead_provider, arg_min(record, r) AS lead_record, count(*) AS observations, count(DISTINCT provider) AS providers, arg_min(record, (NOT established, priority, record::VARCHAR))::VARCHAR AS canonical_id
FROM l JOIN m USING (cluster) LEFT JOIN p USING (cluster) GROUP BY cluster""")
def field_merge(spark, sf_dir):
    """Documents of the same words as observations of one release, half of the clusters by title, the others by URL."""
    rows = observations(spark, sf_dir).withColumns({"titled": F.col("cluster") < "8", "linked": F.lit(True)})
    fields = {"lang": "string", "duration": "bigint", "released": "date"}
    merged, _ = reconcile.reconciled(rows, fields, priority={"lang": LANG_FIRST}, duration="duration", oldest="released")
    return merged.withColumn("released", F.col("released").cast("string"))


@query(f"""SELECT cluster, CASE WHEN lo = hi THEN lo END AS value, CASE WHEN lo != hi THEN lo END AS min_value, CASE WHEN lo != hi THEN hi END AS max_value, hi - lo > 1 AS review FROM (SELECT cluster, min(duration) AS lo, max(duration) AS hi FROM ({OBSERVATIONS}) WHERE duration > 0 GROUP BY 1)""")
def duration_consensus(spark, sf_dir):
    return reconcile.consensus(observations(spark, sf_dir), "cluster", "duration")


def coverage_records(spark, sf_dir) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("provider"), F.col("n_chars").alias("duration"), words.alias("words"))


COVERAGE = """WITH w AS MATERIALIZED (SELECT doc_id AS id, source AS provider, n_chars AS d, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM documents),
p AS MATERIALIZED (SELECT a.id AS id_1, a.provider AS provider_1, b.id AS id_2, b.provider AS provider_2, a.words AS x, b.words AS y FROM w a JOIN w b ON a.d BETWEEN b.d - 3 AND b.d + 3 AND a.provider < b.provider),
pairs AS (SELECT id_1, provider_1, id_2, provider_2 FROM p WHERE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) >= 0.8)"""


@query(f"{COVERAGE} SELECT * FROM pairs")
def coverage_pairs(spark, sf_dir):
    return coverage.fuzzy_pairs(coverage_records(spark, sf_dir), days=None)


@query(f"""{COVERAGE} SELECT id_1, provider_1, id_2, provider_2 FROM pairs WHERE (id_1, provider_2) IN (SELECT (id_1, provider_2) FROM pairs GROUP BY id_1, provider_2 HAVING count(*) = 1)
AND (id_2, provider_1) IN (SELECT (id_2, provider_1) FROM pairs GROUP BY id_2, provider_1 HAVING count(*) = 1)""".replace("(id_1, provider_2) IN (SELECT (id_1, provider_2)", "concat(id_1, provider_2) IN (SELECT concat(id_1, provider_2)").replace("(id_2, provider_1) IN (SELECT (id_2, provider_1)", "concat(id_2, provider_1) IN (SELECT concat(id_2, provider_1)"))
def coverage_unambiguous(spark, sf_dir):
    return coverage.unambiguous(staged(coverage.fuzzy_pairs(coverage_records(spark, sf_dir), days=None), "fuzzy-pairs"))


def dated_records(spark, sf_dir) -> DataFrame:
    return coverage_records(spark, sf_dir).withColumn("released", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 6).cast("int")))


@query(f"{COVERAGE} SELECT * FROM pairs WHERE abs(id_1 % 6 - id_2 % 6) <= 2")
def coverage_dated_pairs(spark, sf_dir):
    return coverage.fuzzy_pairs(dated_records(spark, sf_dir))


PLAIN = """SELECT id_1 AS a, id_2 AS b, row_number() OVER (ORDER BY provider_1, id_1, provider_2, id_2) AS k
FROM (SELECT *, count(*) OVER (PARTITION BY id_1, provider_2) AS n, count(*) OVER (PARTITION BY id_2, provider_1) AS m FROM pairs) WHERE n = 1 AND m = 1"""
#: One pair a step: two groups become one if each id of either is paired with each of the other.
GROUPS = COVERAGE.replace("WITH w AS", "WITH RECURSIVE w AS") + f""", o AS ({PLAIN}),
l AS (SELECT list(id_1 || '-' || id_2) || list(id_2 || '-' || id_1) AS l FROM pairs),
f AS (SELECT 0::BIGINT AS k, (SELECT list([id]) FROM (SELECT DISTINCT unnest([a, b]) AS id FROM o)) AS g
UNION ALL SELECT k, CASE WHEN x = y OR list_contains(flatten([[list_contains(l, i || '-' || j) FOR j IN y] FOR i IN x]), false) THEN g ELSE list_append([z FOR z IN g IF z != x AND z != y], list_concat(x, y)) END
FROM (SELECT o.k, l, g, [z FOR z IN g IF list_contains(z, a)][1] AS x, [z FOR z IN g IF list_contains(z, b)][1] AS y FROM f JOIN o ON o.k = f.k + 1, l)),
gs AS (SELECT unnest(z) AS id, list_min(z) AS "group" FROM (SELECT unnest(g) AS z FROM f WHERE k = (SELECT coalesce(max(k), 0) FROM o)))"""


@query(f"{GROUPS} SELECT * FROM gs")
def coverage_groups(spark, sf_dir):
    return coverage.complete_groups(coverage.fuzzy_pairs(coverage_records(spark, sf_dir), days=None))


@query(f"""{GROUPS}, s AS (SELECT provider, id, coalesce("group", id) AS "group" FROM w LEFT JOIN gs USING (id))
SELECT provider, count(*) AS records, count(DISTINCT "group") AS covered, round(count(DISTINCT "group")::DOUBLE / (SELECT count(DISTINCT "group") FROM s), 9) AS share FROM s GROUP BY 1""")
def coverage_shares(spark, sf_dir):
    return coverage.shares(coverage_records(spark, sf_dir), coverage_groups(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"""{GROUPS} SELECT (SELECT count(*) FROM w) - (SELECT count(*) - count(DISTINCT "group") FROM gs) AS union_count, (SELECT count(*) FROM pairs) - (SELECT count(*) FROM o) AS ambiguous_pairs""")
def coverage_totals(spark, sf_dir):
    records = coverage_records(spark, sf_dir)
    pairs = staged(coverage.fuzzy_pairs(records, days=None), "fuzzy-pairs")
    return coverage.totals(records, pairs, coverage.complete_groups(pairs))


RULES = classify.Cascade(
    safety=[("secret", "(?i)BEGIN [A-Z ]*PRIVATE KEY")],
    positive=[("license", r"\bLicense\b"), ("rights", "All rights reserved")],
    review=[("copyright", "(?i)copyright")],
    exclude=[("shouting", "!!")],
    strong=[("rights", "All rights reserved"), ("mit", r"\bMIT\b")],
)


@query(r"""SELECT doc_id, CASE WHEN s THEN 'excluded' WHEN NOT (l OR r OR c) THEN 'excluded' WHEN x THEN 'excluded' WHEN c THEN 'review' WHEN NOT (r OR m) THEN 'excluded' ELSE 'admit' END AS decision,
CASE WHEN s THEN 'safety' WHEN NOT (l OR r OR c) THEN 'no evidence' WHEN x THEN 'shouting' WHEN c THEN 'review' WHEN NOT (r OR m) THEN 'no strong evidence' END AS reason FROM (
SELECT doc_id, regexp_matches(text, '(?i)BEGIN [A-Z ]*PRIVATE KEY') AS s, regexp_matches(text, '\bLicense\b') AS l, contains(text, 'All rights reserved') AS r, regexp_matches(text, '(?i)copyright') AS c, contains(text, '!!') AS x, regexp_matches(text, '\bMIT\b') AS m FROM documents)""")
def rule_classify(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.withColumn("v", classify.decided(F.col("text"), RULES)).select("doc_id", "v.decision", "v.reason")


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    return pages.select("page_id", parse.html_title(F.col("html")).alias("title"))


DECODED = "replace(replace(replace(replace(regexp_replace({}, '(?i)&nbsp;', ' ', 'g'), '&amp;', '&'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"
PLAIN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("SELECT page_id, " + PLAIN.format(DECODED.format(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")) + " AS text FROM pages")
def html_text(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    return pages.select("page_id", parse.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, " + PLAIN.format(DECODED.format(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)")) + " AS heading FROM pages")
def html_heading(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    return pages.select("page_id", parse.html_heading(F.col("html")).alias("heading"))


TOKENS = "regexp_extract_all(lower(strip_accents({})), '[a-z0-9]+')"


@query(f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM documents")
def title_tokens(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", text.normalized(F.col("text")).alias("tokens"))


@query("SELECT doc_id, text AS repaired FROM documents")
def mojibake_repair(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", text.mojibake_repaired(damaged).alias("repaired"))


@query("SELECT doc_id, split_part(text, chr(10), 1) AS first_line, array_to_string(regexp_extract_all(text, '@([A-Za-z0-9_.-]+)', 1), ',') AS mentions FROM documents")
def text_marks(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", text.first_line(F.col("text")).alias("first_line"), F.array_join(F.regexp_extract_all("text", F.lit("@([A-Za-z0-9_.-]+)"), 1), ",").alias("mentions"))


@query("""SELECT p_partkey, array_to_string([q FOR q IN [lower(p_type), array_to_string(list_slice([x FOR x IN string_split(p_name, ' ') IF x != lower(p_type)], 1, 5), ' '), p_brand] IF q != ''], '|') AS queries FROM part""")
def token_queries(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    part = part.withColumn("names", text.tokens_each(F.array("p_type")))
    return part.select("p_partkey", F.array_join(text.search_queries(F.col("p_name"), F.col("names"), F.lit(None).cast("string"), F.col("p_brand")), "|").alias("queries"))


CANDIDATE = "CASE l_linenumber % 5 WHEN 0 THEN 'see ' || p_name || ' again' WHEN 1 THEN p_type || ' thing' WHEN 2 THEN lower(p_type) || '2024 thing' WHEN 3 THEN 'brand thing ' || substr(p_brand, 7) ELSE 'nothing' END"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 5 = 0 OR l_linenumber % 5 = 3 THEN 3 WHEN l_linenumber % 5 = 1 THEN 2 WHEN l_linenumber % 5 = 2 THEN 1 ELSE 0 END AS tier FROM lineitem JOIN part ON l_partkey = p_partkey""")
def identity_tier(spark, sf_dir):
    items, part = tables(spark, sf_dir, "lineitem", "part")
    t = text.tokens
    known = part.select("*", t(F.col("p_name")).alias("title"), t(F.col("p_brand")).alias("code"), F.array(t(F.col("p_type"))).alias("names"))
    rows = items.join(known, F.col("l_partkey") == F.col("p_partkey")).withColumn("candidate", t(F.expr(CANDIDATE)))
    tier = matching.identity_tier(F.col("title"), F.col("code"), F.col("names"), F.col("candidate"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tier.alias("tier"))


@query("SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'dead' WHEN 'view' THEN 'live' ELSE 'inconclusive' END AS outcome FROM events")
def link_outcomes(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 503)
    return events.select("user_id", "event_id", classify.link_outcome(F.lit("page"), status, F.lit(None).cast("string"), F.lit(""), F.lit("")).alias("outcome"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug, upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS initials FROM part")
def slugs(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return part.select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.initials(F.col("p_name")).alias("initials"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'license')")
def document_search(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return readmodel.searched(docs, "License", ["text", "source"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'rights reserved') THEN 'rights reserved' WHEN regexp_matches(lower(text), '\\bmit\\b') THEN 'mit' END AS term FROM documents")
def term_exclusions(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", text.term_hit(F.col("text"), ["rights reserved"], ["mit"]).alias("term"))


@query("SELECT doc_id, substr(sha, 1, 8) AS record, CASE WHEN quality = 1 THEN 'admit' ELSE 'review' END AS decision FROM (SELECT d.doc_id, md5(source) AS sha, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
def category_verdicts(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    rows = docs.join(labels, "doc_id").select("doc_id", F.substring(F.md5("source"), 1, 8).alias("record"), F.when(F.col("quality") == 1, "admit").otherwise("review").alias("decision"))
    twice = rows.unionByName(rows.withColumn("decision", F.lit("excluded"))).withColumn("ordinal", F.monotonically_increasing_id())
    return feeds.category_scan(twice, "doc_id").select("doc_id", "record", "decision")
