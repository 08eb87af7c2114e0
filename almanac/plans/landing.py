"""Queries of landed feeds, text and page functions, the store's merges and the listings over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import classify, parse, text, urls
from almanac.operators import counters, links, lookup, matching, projection, readmodel, reconcile, upsert
from almanac.operators.staging import scratch_path
from almanac.plans.registry import query, tables
from almanac.sources import feeds, landed
from almanac.streaming import cycle

C = F.col


def lines(spark, sf_dir) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


LINES = "(SELECT doc_id, unnest(range(len(l)))::INT AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


# --- text


STEM = r"regexp_replace(regexp_replace(text, '(?i)https?://\S+', ' ', 'g'), '(?i)\{(?:new|watch/?download:)[^}]*\}', ' ', 'g')"
STEM = rf"regexp_replace(regexp_replace(regexp_replace({STEM}, '(\s+#[\p{{L}}\p{{N}}_-]+)+\s*$', ' '), '\b(?:19|20)[0-9]{{2}}[-/. ][0-9]{{1,2}}[-/. ][0-9]{{1,2}}\b', ' ', 'g'), '\b[0-9]{{2}}[-/. ](?:1[0-2]|0?[1-9])[-/. ](?:3[01]|[12][0-9]|0?[1-9])\b', ' ', 'g')"


@query(f"SELECT doc_id, line, array_to_string([x FOR x IN regexp_extract_all(lower(strip_accents({STEM})), '[a-z0-9]+') IF x NOT IN ('new', 'watch', 'download')], ' ') AS stem FROM {LINES}")
def title_stem(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line", text.title_stem(C("text")).alias("stem"))


@query(f"SELECT doc_id, line, len(list_distinct(regexp_extract_all(lower(text), '#([\\p{{L}}\\p{{N}}_]+)', 1))) AS tags, list_sort(list_distinct(regexp_extract_all(text, '@([A-Za-z0-9_.-]+)', 1)))::VARCHAR AS mentions FROM {LINES}")
def line_marks(spark, sf_dir):
    own = F.concat(F.lit("["), F.array_join(F.sort_array(text.mentions(C("text"))), ", "), F.lit("]"))
    return lines(spark, sf_dir).select("doc_id", "line", F.size(text.hashtags(C("text"))).cast("long").alias("tags"), own.alias("mentions"))


@query("""SELECT doc_id, CASE WHEN p = 0 THEN trim(left(text, 180), ' ') ELSE CASE WHEN p > 91 THEN '…' ELSE '' END || trim(substr(text, greatest(p - 91, 0) + 1, least(p + 89, length(text)) - greatest(p - 91, 0)), ' ') || CASE WHEN p + 89 < length(text) THEN '…' ELSE '' END END AS snippet
FROM (SELECT *, coalesce(list_min([x FOR x IN [strpos(text, 'License'), strpos(text, '@')] IF x > 0]), 0) AS p FROM documents)""")
def snippets(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", text.snippet(C("text"), F.array(F.lit("License"), F.lit("@"))).alias("snippet"))


@query("SELECT c_custkey, 'customer ' || lpad(c_custkey::VARCHAR, 9, '0') AS name FROM customer")
def contributor_names(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "customer")
    return rows.select("c_custkey", text.contributor_name(F.concat("c_name", F.when(C("c_custkey") % 2 == 0, " LS").otherwise(""))).alias("name"))


@query("SELECT p_partkey, array_to_string([upper(left(x, 1)) || substr(x, 2) FOR x IN string_split(p_name, ' ')], ' ') AS name FROM part")
def display_names(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "part")
    return rows.select("p_partkey", text.display_name(text.slug(C("p_name"))).alias("name"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS label FROM supplier")
def clean_labels(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", text.clean_label(F.concat(F.lit("« "), "s_name", F.lit(" »"))).alias("label"))


CODES = "CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN 'see rel-no-' || lpad(c_custkey::VARCHAR, 6, '0') || ' x' WHEN 2 THEN 'https://x.y/articles/' || (c_custkey + 10000) WHEN 3 THEN 'rel ' || c_custkey % 100 END"


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN lpad(c_custkey::VARCHAR, 6, '0') WHEN 2 THEN (c_custkey + 10000)::VARCHAR END AS code FROM customer")
def release_codes(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "customer")
    return rows.select("c_custkey", text.release_code(F.expr(CODES.replace("::VARCHAR", "::STRING"))).alias("code"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_linenumber END::BIGINT AS part, l_linenumber % 4 = 1 AS coded FROM lineitem")
def part_numbers(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "lineitem")
    n, code = C("l_linenumber").cast("string"), F.concat(F.lit("99"), C("l_partkey").cast("string"))
    named = F.when(n % 4 == 0, F.concat(F.lit("Show part ["), n)).when(n % 4 == 1, F.concat(F.lit("["), code, F.lit("]-x "), code, F.lit("_"), n, F.lit(" end"))).when(n % 4 == 2, F.concat(F.lit("動画パート "), n))
    title = F.coalesce(named, F.concat(F.lit("part "), n, F.lit(" and part "), n + 1))
    title = F.when(n % 4 == 3, F.concat(F.lit("part "), n, F.lit(" and part "), (C("l_linenumber") + 1).cast("string"))).otherwise(title)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.part_number(title, code).alias("part"), text.has_code(title, code).alias("coded"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ob' || lpad(o_orderkey::VARCHAR, 4, '0') END AS code FROM orders")
def scene_codes(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "orders")
    title = F.concat(F.lit("The Ob"), F.lpad(C("o_orderkey").cast("string"), 4, "0"), F.lit(" show"))
    source = F.when(C("o_orderkey") % 3 == 0, "coded").when(C("o_orderkey") % 3 == 1, "plain")
    return rows.select("o_orderkey", text.scene_code(title, source, {"coded": r"\bOB\d{3,}\b", "other": "The"}).alias("code"))


@query(r"SELECT doc_id, line, regexp_replace(text, '[^/@\s]+@', '[redacted]@', 'g') IS NOT NULL AS kept, left(CASE WHEN line % 3 = 0 THEN 'Bearer [redacted] at source' WHEN line % 3 = 1 THEN 'GET https://[redacted]@x.y/?token=[redacted]&line=' || line ELSE 'bad' || ' [response body omitted]' END, 240) AS error FROM " + LINES)
def redacted_errors(spark, sf_dir):
    rows = lines(spark, sf_dir)
    doc = C("doc_id").cast("string")
    error = F.when(C("line") % 3 == 0, F.concat(F.lit("Bearer abc"), doc, F.lit(" at source"))).when(C("line") % 3 == 1, F.concat(F.lit("GET https://u:"), doc, F.lit("@x.y/?token="), doc, F.lit("&line="), C("line").cast("string"))).otherwise(F.concat(F.lit("bad <p>"), "text"))
    return rows.select("doc_id", "line", C("text").isNotNull().alias("kept"), text.redacted_error(error, ["s3cret"]).alias("error"))


# --- parsing


@query("""SELECT o_orderkey, strftime(TRY_CAST(d AS DATE), '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, CASE WHEN o_orderkey % 2 = 0 THEN d ELSE 'plain' END AS prefixed
FROM (SELECT *, '1996-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS d FROM orders)""")
def calendar_dates(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "orders")
    day = F.concat(F.lit("1996-"), F.lpad((C("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((C("o_orderkey") % 33).cast("string"), 2, "0"))
    marked = F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("!Date: "), day)).otherwise(F.lit("plain"))
    return rows.select("o_orderkey", parse.calendar_date(day).cast("string").alias("day"), parse.iso_utc(C("o_orderdate").cast("timestamp")).alias("iso"), parse.prefixed_date(marked).alias("prefixed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v > 0 THEN v END::BIGINT AS positive, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS elapsed
FROM (SELECT *, round((l_linenumber - 3) * 10.25)::BIGINT AS v, l_linenumber * 37 AS s FROM lineitem)""")
def number_texts(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "lineitem")
    value = ((C("l_linenumber") - 3) * 10.25).cast("string")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse.positive_number(value).alias("positive"), parse.elapsed_text(C("l_linenumber") * 37).alias("elapsed"))


@query("SELECT p_partkey, array_to_string(CASE WHEN lower(p_name) = lower(p_type) THEN [p_name, p_brand] ELSE [p_name, p_type, p_brand] END, '|') AS names, CASE p_partkey % 4 WHEN 0 THEN 'https://x.y/' || p_partkey WHEN 1 THEN 'https://cdn.y/' || p_partkey WHEN 2 THEN 'https://base.z/' || p_partkey END AS poster FROM part")
def names_and_posters(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "part")
    key = C("p_partkey").cast("string")
    path = F.when(key % 4 == 0, F.concat(F.lit("https://x.y/"), key)).when(key % 4 == 1, F.concat(F.lit("//cdn.y/"), key)).when(key % 4 == 2, F.concat(F.lit("/"), key)).otherwise(F.concat(F.lit("x/"), key))
    listed = F.concat("p_name", F.lit(", "), "p_type", F.lit(" and "), "p_brand", F.lit(" & "), "p_name", F.lit(" ,"))
    return rows.select("p_partkey", F.array_join(parse.split_names(listed), "|").alias("names"), parse.absolute_url(path, "https://base.z").alias("poster"))


@query("""SELECT page_id, len(l) AS n, l[1] AS first FROM (SELECT page_id, list_slice(list_reverse(list_sort(list_distinct(l))), 1, 100) AS u, list_slice(l, 1, 1) AS l0, l AS l FROM (SELECT page_id, [x FOR x, i IN l IF list_position(l, x) = i] [1:4] AS l FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS l FROM pages)))""")
def related_links(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    ids = parse.related_ids(C("html"), r'href="/([^"]*)"', 4)
    return pages.select("page_id", F.size(ids).cast("long").alias("n"), F.try_element_at(ids, F.lit(1)).alias("first"))


def headed(spark, sf_dir) -> DataFrame:
    """Pages with varied heads made of their own titles: attributes in two orders, some tags missing."""
    (pages,) = tables(spark, sf_dir, "pages")
    plain = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>(.*?)</title>", 1), "[^A-Za-z0-9]+", " "))
    n, title = C("page_id"), C("title")
    meta = F.when(n % 4 == 3, "").when(n % 2 == 0, F.concat(F.lit('<meta property="og:title" content="'), title, F.lit('">'))).otherwise(F.concat(F.lit("<META content='"), title, F.lit("' name='og:title'>")))
    link = F.when(n % 3 == 0, F.concat(F.lit('<link rel="canonical" href="'), "url", F.lit('">'))).when(n % 3 == 1, F.concat(F.lit("<link href='"), "url", F.lit("' rel='canonical'>"))).otherwise(F.concat(F.lit('<meta content="og:'), "url", F.lit('" property="og:url">')))
    seconds = F.concat(F.lit('<meta property="og:duration" content="'), (n * 7).cast("string"), F.lit('">'))
    video = F.concat(F.lit('{"@type":"VideoObject","name":"'), title, F.lit('","duration":"PT'), (n % 50).cast("string"), F.lit('M","actor":[{"name":"A'), (n % 5).cast("string"), F.lit('"},"B"]}'))
    data = F.when(n % 3 == 0, video).when(n % 3 == 1, F.concat(F.lit('{"@graph":[{"@type":"Page"},'), video, F.lit("]}"))).otherwise('{"@type":"Page","name":"no video"}')
    block = F.concat(F.lit('<!-- <li class="vit-uploader"><a href="/profile/none/1">x</a></li> --><ul><li class="vit-uploader on"><a href="/profile/user'), (n % 9).cast("string"), F.lit('/all">u</a></li></ul>'))
    rows = pages.select("page_id", "url", "html", plain.alias("title"))
    return rows.select("page_id", "url", "title", F.concat(meta, link, seconds, F.lit('<script type="application/ld+json">'), data, F.lit("</script>"), block, "html").alias("page"))


TITLES = "(SELECT *, trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '[^A-Za-z0-9]+', ' ', 'g')) AS title FROM pages)"


@query(f"SELECT page_id, CASE WHEN page_id % 4 != 3 THEN nullif(title, '') END AS title, page_id % 3 = 2 AS other FROM {TITLES}")
def html_meta(spark, sf_dir):
    rows = headed(spark, sf_dir).withColumn("m", parse.meta_tags(C("page")))
    return rows.select("page_id", F.try_element_at("m", F.lit("og:title")).alias("title"), F.map_contains_key("m", "og:url").alias("other"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'og:' ELSE '' END || url AS canonical FROM pages")
def html_canonical(spark, sf_dir):
    return headed(spark, sf_dir).select("page_id", parse.canonical_url(C("page")).alias("canonical"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 != 2 THEN nullif(title, '') END AS name, CASE WHEN page_id % 3 != 2 AND page_id % 50 > 0 THEN (page_id % 50) * 60 END::BIGINT AS seconds, CASE WHEN page_id % 3 != 2 THEN 'A' || page_id % 5 || ', B' ELSE '' END AS actors FROM {TITLES}")
def html_jsonld(spark, sf_dir):
    rows = headed(spark, sf_dir).withColumn("v", parse.json_ld(C("page")))
    return rows.select("page_id", C("v.name").alias("name"), parse.duration_seconds(C("v.duration")).alias("seconds"), F.array_join("v.actors", ", ").alias("actors"))


@query("SELECT page_id, 'user' || page_id % 9 AS account, CASE WHEN page_id > 0 THEN page_id * 7 END::BIGINT AS seconds FROM pages")
def html_uploader(spark, sf_dir):
    return headed(spark, sf_dir).select("page_id", parse.block_account(C("page")).alias("account"), parse.page_seconds(C("page")).alias("seconds"))


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 4 != 3 AND title != '' THEN title WHEN page_id % 5 != 4 THEN nullif(regexp_replace(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '\\s+', ' ', 'g'), '') END AS title FROM (SELECT page_id, title, {{}} AS html FROM {TITLES})".format("replace(replace(html, '&amp;', '&'), '&quot;', '\"')"))
def recipe_titles(spark, sf_dir):
    host = F.when(C("page_id") % 5 == 4, "none").otherwise("x.y")
    known = {"title": F.when(C("page_id") % 2 == 0, F.try_element_at(parse.meta_tags(C("page")), F.lit("og:title")))}
    filled = parse.filled_by_recipe(C("page"), host, {"x.y": {"title": "<title>(.*?)</title>"}, "z": {}}, known)
    return headed(spark, sf_dir).select("page_id", filled["title"].alias("title"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IS NOT NULL")
def embedded_pages(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct("lang", "n_chars")).alias("data")).alias("articles")).alias("props")))
    body = F.when(C("doc_id") % 2 == 0, body).otherwise(F.replace(body, F.lit('"'), F.lit("&quot;")))
    page = F.concat(F.lit("<script>var a = 1</script><script data-page='app' type='application/json'>"), body, F.lit("</script>"))
    return feeds.embedded_records(docs.where("lang is not null").select("doc_id", page.alias("page")), "page", "lang: string, n_chars: long")


@query("SELECT p_partkey, p_partkey::VARCHAR AS id, p_name AS title, p_size * 60 + 5 AS seconds, (p_partkey % 9 + 1) || 'k' AS views FROM part WHERE p_partkey % 3 != 2")
def listing_cards(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    key = C("p_partkey").cast("string")
    card = F.concat(F.lit('<p>head</p><article class="c"><a href="/v/'), key, F.lit('" title="'), "p_name", F.lit('">x</a>'), F.when(key % 3 != 2, F.concat(F.lit("<b>"), C("p_size").cast("string"), F.lit(":05</b>"))).otherwise(""), (key % 9 + 1).cast("int").cast("string"), F.lit("k views</article>"))
    return feeds.cards(part.select("p_partkey", card.alias("page")), "page").withColumn("seconds", C("seconds").cast("int"))


@query("SELECT r_regionkey, 'nation-' || n_nationkey AS slug, n_name AS name, n_nationkey AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 != 0")
def rosters(spark, sf_dir):
    nation, region = tables(spark, sf_dir, "nation", "region")
    slug = F.when(C("n_nationkey") % 4 != 0, F.concat(F.lit("nation-"), C("n_nationkey").cast("string"))).otherwise("")
    entries = nation.groupBy(C("n_regionkey").alias("r_regionkey")).agg(F.to_json(F.collect_list(F.struct(slug.alias("slug"), C("n_name").alias("name"), C("n_nationkey").alias("count")))).alias("roster"))
    return entries.join(region, "r_regionkey").select("r_regionkey", F.inline(lookup.roster(C("roster")))).withColumnRenamed("count", "n")


@query(r"""SELECT page_id, form, CASE WHEN form = 2 THEN 'a.' ELSE '' END || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '')) AS loose,
form <= 1 AND regexp_matches(url, '^https://(www\.)?example\.(org|com)([/?#]|$)') AS allowed, false AS shaped FROM (SELECT page_id, url, unnest(range(5))::INT AS form FROM (SELECT page_id, regexp_replace(url, '://(?:[^/?#]*\.)?(example\.[a-z]+)', '://\1') AS url FROM pages))""")
def url_checks(spark, sf_dir):
    """Addresses as they are, on the usual port, and, never allowed, on a sub-domain, under a user's name, on another port."""
    (pages,) = tables(spark, sf_dir, "pages")
    pages = pages.withColumn("url", F.regexp_replace("url", r"://(?:[^/?#]*\.)?(example\.[a-z]+)", "://$1"))
    spelled = lambda host: F.regexp_replace("url", "^([a-z]+)://([^/?#]+)", f"$1://{host}")
    port = F.when(C("url").startswith("https"), spelled("$2:443")).otherwise(C("url"))
    rows = pages.select("page_id", F.posexplode(F.array(C("url"), port, spelled("a.$2"), spelled("me@$2"), spelled("$2:8443"))).alias("form", "url"))
    return rows.select("page_id", "form", urls.loose_url(C("url")).alias("loose"), urls.allowed_host(C("url"), ["example.org", "example.com"]).alias("allowed"), urls.has_shape(C("url"), "other.example", "/.*").alias("shaped"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted' WHEN 2 THEN 'refused' WHEN 3 THEN 'accepted' ELSE 'refused' END = 'accepted' AS accepted FROM pages""")
def detail_pages(spark, sf_dir):
    """Detail pages that say they are the release asked for, another one, or nothing, where the address reached counts."""
    (pages,) = tables(spark, sf_dir, "pages")
    n = C("page_id") % 5
    head = F.when(n == 0, F.concat(F.lit('<link rel="canonical" href="'), "url", F.lit('">'))).when(n == 1, F.concat(F.lit("<meta property='og:url' content='"), F.upper("url"), F.lit("'>"))).when(n == 2, '<link rel="canonical" href="https://other.example/x">').otherwise("")
    reached = F.when(n == 4, F.concat(F.lit("https://away.example/"), C("page_id").cast("string"))).otherwise(C("url"))
    bare = F.regexp_replace("html", "(?is)<(link|meta)\\b[^>]*>", "")
    rows = pages.select("page_id", "url", F.concat(head, bare).alias("page"), reached.alias("reached"))
    kept = lookup.of_release(rows, "url", "page", "reached").select("page_id", F.lit(True).alias("accepted"))
    return pages.select("page_id").join(kept, "page_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


# --- classification


@query("SELECT doc_id, CASE WHEN contains(text, '!!') THEN 'excluded' WHEN regexp_matches(text, '\\bLicense\\b') THEN 'admit' ELSE 'excluded' END AS decision, CASE WHEN contains(text, '!!') OR regexp_matches(text, '\\bLicense\\b') THEN CASE WHEN contains(text, '!!') THEN 'shouting' ELSE 'license' END ELSE '' END AS keywords FROM documents")
def verdict_audits(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    rules = classify.Cascade(safety=[("shouting", "!!")], positive=[("license", r"\bLicense\b")], strong=[("license", r"\bLicense\b")])
    audit = classify.verdict_audit(classify.decided(C("text"), rules))
    return docs.select("doc_id", audit.alias("a")).select("doc_id", C("a")["decision"].alias("decision"), C("a")["keywords"].alias("keywords"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'definitive' WHEN 'view' THEN 'ok' ELSE 'inconclusive' END AS http, CASE WHEN event_type = 'error' THEN 'attention' WHEN event_id % 2 = 0 THEN 'waiting' ELSE 'healthy' END AS card,
CASE WHEN event_id % 5 = 0 AND event_type = 'view' THEN 'live' WHEN event_id % 5 = 1 AND event_type = 'view' THEN 'dead' WHEN event_id % 5 = 4 AND event_type = 'view' AND user_id = 1 THEN 'live' ELSE 'inconclusive' END AS api FROM events""")
def event_states(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    status = F.when(C("event_type") == "error", 410).when(C("event_type") == "view", 200).otherwise(503)
    kind = F.when(C("event_type") == "error", "failing").otherwise("ok")
    n = C("event_id") % 5
    record = lambda x: F.to_json(F.struct(F.concat(F.lit("u"), x.cast("string")).alias("id"), "props"))
    # the record itself, none, a challenge page, a number for an id, the record of user 1
    body = F.when(n == 0, F.concat(F.lit("["), record(C("user_id")), F.lit(', {"id":"x"}]'))).when(n == 1, " [ ] ").when(n == 2, "<html>").when(n == 3, F.to_json(F.struct(C("user_id").alias("id")))).otherwise(record(F.lit(1)))
    content = F.when(n == 2, "text/html").otherwise("application/json")
    return events.select("event_id", classify.http_class(status).alias("http"), classify.card_state(kind, C("event_id") % 2).alias("card"), classify.link_outcome(F.lit("api"), status, content, body, F.concat(F.lit("u"), C("user_id").cast("string"))).alias("api"))


# --- lookups and the store


@query("SELECT o_orderkey, o_orderpriority != '1-URGENT' AS kept FROM orders")
def exclusion_split(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    kept, out = lookup.split_by(orders, C("o_orderpriority") == "1-URGENT")
    return kept.select("o_orderkey", F.lit(True).alias("kept")).unionByName(out.select("o_orderkey", F.lit(False).alias("kept")))


@query("SELECT 'feed:' || o_custkey || ':' || o_orderkey AS release_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def suffix_releases(spark, sf_dir):
    orders, items = tables(spark, sf_dir, "orders", "lineitem")
    own = orders.select(F.concat_ws(":", F.lit("feed"), "o_custkey", "o_orderkey").alias("release_id"))
    return lookup.suffix_owners(own, items.where("l_returnflag = 'R'").select(C("l_orderkey").alias("record")))


@query("""WITH c AS (SELECT l_partkey * 100000 + l_suppkey AS code, l_orderkey, l_linenumber, l_extendedprice AS duration, CASE WHEN l_suppkey % 2 = 0 THEN 'one' ELSE l_returnflag END AS publisher, l_orderkey % 5 != 0 AS sound, l_returnflag = 'R' AS dead,
CASE l_orderkey % 9 WHEN 0 THEN NULL ELSE l_linenumber END AS number FROM lineitem),
g AS (SELECT code, count(*) >= 2 AND count(DISTINCT publisher) = 1 AND count(DISTINCT duration) = count(*) AND count(DISTINCT number) = count(*) AS multi FROM c GROUP BY 1)
SELECT code AS release_id, l_orderkey, l_linenumber, CASE WHEN multi THEN number END::BIGINT AS part, NULL::INT AS tier, 'high' AS confidence FROM c JOIN g USING (code) WHERE sound AND NOT dead""")
def exact_code_lane(spark, sf_dir):
    """Line items as uploads that carry the code of part and supplier; some addresses are no watch pages, some are dead."""
    (items,) = tables(spark, sf_dir, "lineitem")
    code, own, n = C("l_partkey") * 100000 + C("l_suppkey"), F.concat("l_orderkey", F.lit("x"), "l_linenumber"), C("l_linenumber").cast("string")
    url = F.concat(F.when(C("l_orderkey") % 5 == 0, "https://tube.example/hd/").otherwise("https://tube.example/video-"), own, F.lit("/"))
    title = F.when(C("l_orderkey") % 9 == 0, F.concat(F.lit("part "), n, F.lit(" and part "), (C("l_linenumber") + 1).cast("string"))).when(C("l_orderkey") % 2 == 0, F.concat(F.lit("Show Part ["), n, F.lit("]"))).otherwise(F.concat(F.lit("x "), code.cast("string"), F.lit("_"), n))
    publisher = F.when(C("l_suppkey") % 2 == 0, "one").otherwise(C("l_returnflag"))
    rows = items.select(code.alias("code"), "l_orderkey", "l_linenumber", url.alias("url"), title.alias("title"), publisher.alias("publisher"), C("l_extendedprice").alias("duration"), (C("l_returnflag") == "R").alias("dead"))
    releases = rows.select(C("code").alias("release_id"), "code").distinct()
    found = matching.exact_code(releases, rows.drop("dead"), rows.where("dead").select(C("code").alias("release_id"), "url"), urls.has_shape(C("url"), "tube.example", "/video-[0-9x]+/"))
    return found.select("release_id", "l_orderkey", "l_linenumber", "part", "tier", "confidence")


@query("""SELECT p_partkey, array_to_string(CASE p_partkey % 5 WHEN 0 THEN [p_name, p_brand] WHEN 1 THEN [p_name || ' & Co''s "x"'] WHEN 2 THEN [p_name, p_type, p_brand, '7'] WHEN 3 THEN [p_name] ELSE [] END, '|') AS names FROM part""")
def listed_names(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "part")
    n, text_of = C("p_partkey") % 5, lambda *parts: F.to_json(F.array(F.concat(*parts)))
    named = F.to_json(F.struct(F.concat("p_name", F.lit(" &amp; Co&#39;s &QUOT;x&quot; ")).alias("name")))
    mixed = F.concat(F.lit('["'), "p_name", F.lit(' and "'), F.lit(',{"name":"'), "p_type", F.lit('"},3,null,["x"],{"name":"'), "p_brand", F.lit('"},"'), "p_name", F.lit('",{"name":7}]'))
    value = F.when(n == 0, F.concat(F.lit('"'), "p_name", F.lit(", "), "p_brand", F.lit(' & "'))).when(n == 1, named).when(n == 2, mixed).when(n == 3, text_of("p_name")).otherwise("12")
    return rows.select("p_partkey", F.array_join(parse.listed_names(value), "|").alias("names"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'REGION_' || n_regionkey ELSE n_name END AS label FROM nation")
def label_aliases(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    names = nation.where("n_nationkey % 5 = 0").select(C("n_name").alias("alias"), F.concat(F.lit("REGION_"), C("n_regionkey").cast("string")).alias("canonical"))
    return reconcile.aliased(nation.select("n_nationkey", C("n_name").alias("label")), names, "label").select("n_nationkey", "label")


def order_observations(spark, sf_dir) -> DataFrame:
    (orders,) = tables(spark, sf_dir, "orders")
    return orders.select(C("o_custkey").alias("cluster"), C("o_orderstatus").alias("provider"), C("o_orderkey").alias("record"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), C("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("released"))


@query("""WITH o AS (SELECT o_custkey AS cluster, o_orderstatus AS provider, o_orderdate::DATE AS released, (left(o_orderpriority, 1)::INT, o_orderstatus, o_orderkey) AS r, o_totalprice AS price, o_custkey % 3 != 0 AS titled, o_custkey % 7 + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE o_orderkey % 2 END AS seconds FROM orders),
c AS (SELECT *, titled AND min(nullif(seconds, 0)) OVER w = max(nullif(seconds, 0)) OVER w AS old FROM o WINDOW w AS (PARTITION BY cluster))
SELECT cluster, arg_min(price, r) AS price, arg_min(provider, r) AS price_from, strftime(CASE WHEN bool_and(old) THEN min(released) ELSE arg_min(released, r) END, '%Y-%m-%d') AS released, CASE WHEN bool_and(old) THEN arg_min(provider, (released, r)) ELSE arg_min(provider, r) END AS released_from FROM c GROUP BY 1""")
def oldest_dates(spark, sf_dir):
    """Clusters of which some are titled and some of those agree on the duration: only there the oldest date counts."""
    n = C("cluster")
    rows = order_observations(spark, sf_dir).withColumns({"titled": n % 3 != 0, "seconds": n % 7 + F.when(n % 2 == 0, 1).otherwise(C("record") % 2)})
    out = reconcile.merged(rows, {"price": "double", "released": "date", "seconds": "bigint"}, duration="seconds", oldest="released")
    return out.select("cluster", "price", "price_from", C("released").cast("string").alias("released"), "released_from")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'page' WHEN o_orderkey % 5 = 1 THEN 'prior' ELSE 'current' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS sources FROM orders")
def metadata_overlays(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    n = C("o_orderkey")
    title = upsert.overlay_field(F.lit("current"), F.when(n % 5 == 0, "page"), F.lit("prior"), n % 5 == 1, F.lit(False))
    fields = F.create_map(F.lit("title"), F.lit("page"), F.lit("date"), F.lit("feed"))
    url = F.concat(F.lit("u"), n.cast("string"))
    kept = upsert.evidence_reset(fields, url, F.when(n % 2 == 0, url).otherwise(F.lit(None).cast("string")))
    return orders.select("o_orderkey", title.alias("title"), F.size(kept).cast("long").alias("sources"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS release_id FROM lineitem")
def reassigned_links(spark, sf_dir):
    items, suppliers = tables(spark, sf_dir, "lineitem", "supplier")
    ids = suppliers.where("s_suppkey % 3 = 0").select(C("s_suppkey").alias("release_id"), (C("s_suppkey") + 1000000).alias("canonical_id"))
    return upsert.reassigned(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C("l_suppkey").alias("release_id")), ids)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS entries, 'new' AS first_state FROM customer")
def provenance_unions(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "customer")
    entry = lambda url, state: F.struct(F.lit("feed").alias("source"), url.alias("source_url"), F.lit(None).cast("string").alias("record_url"), F.lit(state).alias("state"))
    old = F.array(entry(F.lit("a"), "old"), entry(F.lit("b"), "old"))
    new = F.array(entry(F.when(C("c_custkey") % 2 == 0, "b").otherwise("c"), "new"), entry(F.lit("a"), "new"))
    both = upsert.merged_provenance(old, new)
    return rows.select("c_custkey", F.size(both).cast("long").alias("entries"), both[0]["state"].alias("first_state"))


@query("""SELECT l_orderkey AS release_id, l_partkey AS url FROM lineitem WHERE l_orderkey % 2 = 0 AND l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 2 = 1""")
def link_replacement(spark, sf_dir):
    items, orders = tables(spark, sf_dir, "lineitem", "orders")
    old = items.select(C("l_orderkey").alias("release_id"), C("l_partkey").alias("url"))
    new = items.where("l_returnflag = 'R'").select(C("l_orderkey").alias("release_id"), C("l_partkey").alias("url"))
    ids = items.where("l_orderkey % 2 = 0").select(C("l_orderkey").alias("release_id"))
    return upsert.links_replaced(old, new, ids)


@query("""SELECT user_id AS run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts) FILTER (event_type != 'view'), '%Y-%m-%d %H:%M:%S') AS finished_at, arg_max(event_type != 'error', ts) FILTER (event_type != 'view') AS ok FROM events GROUP BY 1""")
def run_ledger(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select(C("user_id").alias("run_id"), C("ts").alias("at"), (C("event_type") != "view").alias("closed"), (C("event_type") != "error").alias("ok"), F.when(C("event_type") == "error", "failed").alias("error"))
    out = upsert.run_ledger(rows)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("run_id", at("started_at"), at("finished_at"), "ok")


@query("SELECT count(*) FILTER (event_type NOT IN ('view', 'click')) AS winner_index, count(*) FILTER (event_type = 'click') AS winner_search, count(*) FILTER (event_type = 'view') AS winner_fallback FROM events")
def winner_split(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return readmodel.winner_split(events.select(F.when(C("event_type") == "click", "search").when(C("event_type") == "view", "fallback").otherwise(C("event_type")).alias("rung")), "index", "search")


HISTORY = """SELECT l_suppkey AS release_id, l_partkey AS url, bool_or(l_returnflag = 'R') AS dead, strftime(min(l_shipdate), '%Y-%m-%d') AS checked_at, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) FILTER (l_linestatus = 'F') AS matching FROM lineitem GROUP BY 1, 2"""


def histories(spark, sf_dir) -> DataFrame:
    (items,) = tables(spark, sf_dir, "lineitem")
    return items.select(C("l_suppkey").alias("release_id"), C("l_partkey").alias("url"), (C("l_returnflag") == "R").alias("dead"), F.to_date("l_shipdate").cast("string").alias("checked_at"), F.when(C("l_linestatus") == "F", "F").alias("matching"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("ordinal"))


@query(HISTORY)
def history_links(spark, sf_dir):
    return reconcile.history_links(histories(spark, sf_dir), "release_id")


STORE = """WITH o AS (SELECT n_regionkey * 100 + s_suppkey % 40 AS cluster, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS provider, s_suppkey AS record, s_acctbal AS price FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT cluster, min(record) AS canonical FROM o GROUP BY 1 HAVING count(*) = 1 OR cluster % 4 = 0 OR cluster % 4 = 1 AND count(DISTINCT provider) >= 2 AND count(*) = count(DISTINCT provider) OR cluster % 4 > 1 AND bool_and(record % 3 > 0) OR count(*) = count(DISTINCT provider) AND count(*) >= 2),
i AS (SELECT record, coalesce(canonical, record) AS release FROM o LEFT JOIN m USING (cluster))"""


@query(STORE + """ SELECT 'release' AS kind, canonical AS id, (SELECT arg_min(price, (provider, record)) FROM o WHERE o.cluster = m.cluster) AS n FROM m UNION ALL SELECT 'observation', release, count(*)::DOUBLE FROM i GROUP BY release
UNION ALL SELECT 'link', release, count(DISTINCT l_partkey)::DOUBLE FROM i JOIN lineitem ON l_suppkey = record GROUP BY release UNION ALL SELECT 'deleted', record, NULL FROM i WHERE record != release""")
def reconciled_store(spark, sf_dir):
    suppliers, nation = tables(spark, sf_dir, "supplier", "nation")
    key = C("s_suppkey")
    rows = suppliers.join(nation, C("s_nationkey") == C("n_nationkey")).select((C("n_regionkey") * 100 + key % 40).alias("cluster"), F.when(key % 3 == 0, "a").when(key % 3 == 1, "b").otherwise("c").alias("provider"), key.alias("record"), key.alias("release_id"), F.lit(0).alias("priority"), C("s_acctbal").alias("price"), F.lit(True).alias("established"), F.lit(0).alias("live"))
    # clusters by URL, by title, and such of which some records have no URL
    rows = rows.withColumns({"titled": C("cluster") % 4 == 1, "linked": (C("cluster") % 4 < 2) | (C("record") % 3 > 0)})
    releases, observations, found, deleted = reconcile.reconciled_store(rows, histories(spark, sf_dir), {"price": "double"})
    part = lambda df, kind, n: df.select(F.lit(kind).alias("kind"), C("release_id").cast("long").alias("id"), n.cast("double").alias("n"))
    counted = lambda df: df.groupBy("release_id").agg(F.count(F.lit(1)).alias("n"))
    return part(releases, "release", C("price")).unionByName(part(counted(observations), "observation", C("n"))).unionByName(part(counted(found), "link", C("n"))).unionByName(part(deleted, "deleted", F.lit(None)))


# --- feeds


@query("SELECT l_partkey AS url, max(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem WHERE l_suppkey % 3 != 0 GROUP BY 1")
def candidate_search(spark, sf_dir):
    items, suppliers = tables(spark, sf_dir, "lineitem", "supplier")
    results = suppliers.select(C("s_suppkey").alias("query"), (C("s_suppkey") % 3 != 0).alias("ok"), F.lit(None).cast("string").alias("error"))
    return feeds.search_union(results, items.select(C("l_suppkey").alias("query"), C("l_partkey").alias("url"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("ordinal"))).select("url", "ordinal")


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 2 = 0 THEN (24 - s_nationkey) // 2 ELSE 2147483647 END::INT AS priority FROM supplier")
def feed_priorities(spark, sf_dir):
    suppliers, nation = tables(spark, sf_dir, "supplier", "nation")
    listed = feeds.registry(nation.where("n_nationkey % 2 = 0").select(C("n_nationkey").alias("s_nationkey"), (-C("n_nationkey")).alias("ordinal")))
    return feeds.with_priority(suppliers.select("s_suppkey", "s_nationkey"), listed, "s_nationkey").select("s_suppkey", "s_nationkey", "priority")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def exact_details(spark, sf_dir):
    orders, customers = tables(spark, sf_dir, "orders", "customer")
    details = customers.where("c_custkey % 2 = 0").select(F.concat(F.lit("c-"), "c_custkey").alias("slug"), "c_name")
    return lookup.exact_details(orders.select("o_orderkey", F.concat(F.lit("c-"), "o_custkey").alias("slug")), details).select("o_orderkey", "c_name")


@query("""SELECT c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ':' || c_mktsegment END || ':' || c_custkey AS release_id, coalesce(n_name, c_nationkey::VARCHAR) AS source, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR ELSE c_mktsegment END AS label_id,
coalesce(n_name, c_nationkey::VARCHAR) AS label, c_name AS title, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT END AS duration, false AS duration_review, '' AS poster_url, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS tags,
CASE WHEN c_custkey % 4 != 0 THEN 'https://x.y/' || c_custkey END AS release_url, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS links, CASE WHEN c_custkey % 5 = 0 THEN '2024-01-01' END AS checked_at,
CASE WHEN c_custkey % 7 = 0 THEN '2024-02-02' WHEN c_custkey % 5 = 0 THEN '2024-01-03' END AS metadata_checked_at, coalesce(n_name, c_nationkey::VARCHAR) || '/' || c_custkey AS provenance
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 != 0) ON n_nationkey = c_nationkey""")
def normalised_releases(spark, sf_dir):
    """Customers as records of feeds, a fifth of which the store has already; some feeds have no name."""
    customers, nation = tables(spark, sf_dir, "customer", "nation")
    n, key = C("c_custkey"), C("c_custkey").cast("string")
    day = lambda x: F.lit(x).cast("timestamp")
    label = F.when(n % 3 != 0, C("c_mktsegment"))
    records = customers.select(C("c_nationkey").alias("source_id"), key.alias("record_id"), label.alias("label_id"), C("c_name").alias("title"), F.when(C("c_acctbal") > 0, F.floor("c_acctbal")).alias("duration"), F.when(n % 2 == 0, F.array("c_mktsegment")).alias("tags"), F.when(n % 4 != 0, F.concat(F.lit("https://x.y/"), key)).otherwise("").alias("release_url"), F.when(n % 7 == 0, day("2024-02-02")).alias("metadata_checked_at"))
    known = customers.where("c_custkey % 5 = 0").select(reconcile.release_id(C("c_nationkey").cast("string"), label, key).alias("release_id"), F.array(F.lit("a"), F.lit("b")).alias("links"), day("2024-01-01").alias("checked_at"), day("2024-01-03").alias("metadata_checked_at"))
    feeds_ = nation.where("n_nationkey % 6 != 0").select(C("n_nationkey").alias("source_id"), C("n_name").alias("name"))
    out = projection.releases_of(records, feeds_, known, day("2024-03-03"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    entry = F.concat_ws("/", C("provenance")[0]["source"], C("provenance")[0]["record_id"])
    return out.select("release_id", "source", "label_id", "label", "title", "duration", "duration_review", "poster_url", F.size("tags").alias("tags"), "release_url", F.size("links").alias("links"), at("checked_at"), at("metadata_checked_at"), entry.alias("provenance"))


@query("SELECT o_orderkey AS release_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS checked FROM orders")
def carried_columns(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    rows = orders.select(C("o_orderkey").alias("release_id"), F.lit("new").alias("checked"))
    return lookup.carried_over(rows, orders.where("o_orderkey % 3 = 0").select(C("o_orderkey").alias("release_id"), C("o_orderstatus").alias("checked")), ["checked"])


@query("SELECT l_orderkey AS release_id, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1997-03-01' AND '1997-06-30')")
def window_observations(spark, sf_dir):
    orders, items = tables(spark, sf_dir, "orders", "lineitem")
    rows = items.select(C("l_orderkey").alias("release_id"), "l_linenumber", "l_partkey", "l_suppkey")
    return lookup.in_window_of(rows, orders.select(C("o_orderkey").alias("release_id"), "o_orderdate"), "o_orderdate", F.lit("1997-03-01").cast("timestamp"), F.lit("1997-06-30").cast("timestamp"))


@query("SELECT event_id FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-20 12:00:00' AND event_id % 7 != 0")
def ingest_window(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select("event_id", F.when(C("event_id") % 7 != 0, C("ts").cast("string")).otherwise("soon").alias("at"))
    return feeds.ingest_window(rows, "at", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20 12:00:00").cast("timestamp")).select("event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def tagged_orders(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    level = F.when(C("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.array(F.lit("Top -- Tier"), F.lit("x"))).otherwise(F.array(F.lit("top"), F.lit("X!")))
    rows = orders.select("o_orderkey", "o_orderstatus", level.alias("tags"))
    return feeds.of_entity(feeds.with_all_tags(rows, "tags", ["top tier", "x"]), "o_orderstatus", "f").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size % 2 = 0 AND p_partkey % 3 != 0 GROUP BY 1, 2")
def timeline_media(spark, sf_dir):
    items, part = tables(spark, sf_dir, "lineitem", "part")
    posts = items.groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("attachments"))
    media = part.select(C("p_partkey").alias("media_id"), F.when(C("p_size") % 2 == 0, "video").otherwise("image").alias("kind"), (C("p_partkey") % 3 != 0).alias("accessible"), F.lit(None).cast("double").alias("price"))
    return feeds.posts_with_media(posts, media).select("o_orderkey", C("media_id").alias("l_partkey"))


WALK_BOUND = 12
#: One record a step: the starts' own pages first, then the records named, each start with its queue and what it has followed.
WALK = f"""WITH RECURSIVE e AS (SELECT l_partkey AS id, l_suppkey * 3 AS related, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem WHERE l_partkey != l_suppkey * 3 GROUP BY 1, 2),
adj AS (SELECT id, list(related ORDER BY place, related) AS names FROM e GROUP BY 1),
w AS (SELECT s_suppkey AS start, CASE WHEN s_nationkey % 2 = 0 THEN [s_suppkey * 3, s_suppkey * 5] ELSE [s_suppkey * 7] END AS s, []::BIGINT[] AS q, []::BIGINT[] AS walked, 0 AS f, 0 AS root, NULL::BIGINT AS id, NULL::BOOLEAN AS new, NULL::BOOLEAN AS ok, 0 AS step FROM supplier
UNION ALL SELECT start, s[2:], CASE WHEN is_root THEN CASE WHEN ok THEN q || names[1:greatest({WALK_BOUND} - len(q), 0)] ELSE q END
  WHEN NOT new THEN q[2:] WHEN ok THEN q[2:] || [x FOR x IN names IF NOT list_contains(walked, x)][1:{WALK_BOUND} - f - len(q)] ELSE q[2:] END,
  CASE WHEN new AND (ok OR NOT is_root) THEN list_append(walked, own) ELSE walked END, f + CASE WHEN new AND NOT is_root THEN 1 ELSE 0 END, CASE WHEN is_root THEN 1 ELSE 0 END, own, new, ok, step + 1
FROM (SELECT w.* EXCLUDE (id, new, ok, root), len(s) > 0 AS is_root, CASE WHEN len(s) > 0 THEN s[1] ELSE q[1] END AS own, len(s) > 0 OR NOT list_contains(walked, q[1]) AS new, coalesce((p_size + start) % 4 != 0, false) AS ok, coalesce(names, []) AS names
  FROM w LEFT JOIN adj ON adj.id = CASE WHEN len(s) > 0 THEN s[1] ELSE q[1] END LEFT JOIN part ON p_partkey = CASE WHEN len(s) > 0 THEN s[1] ELSE q[1] END WHERE len(s) > 0 OR len(q) > 0 AND f < {WALK_BOUND}))
SELECT start, id, row_number() OVER (PARTITION BY start, root ORDER BY step)::INT AS nth, root = 1 AS own, ok AS admitted FROM w WHERE new"""


@query(WALK)
def related_walk(spark, sf_dir):
    """For every supplier the records that its walk follows: a bound of 12 cuts inside the first or second level."""
    items, part, suppliers = tables(spark, sf_dir, "lineitem", "part", "supplier")
    edges = items.select(C("l_partkey").alias("id"), (C("l_suppkey") * 3).alias("related"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("place"))
    ids = F.when(C("s_nationkey") % 2 == 0, F.array(C("s_suppkey") * 3, C("s_suppkey") * 5)).otherwise(F.array(C("s_suppkey") * 7))
    starts = suppliers.select(C("s_suppkey").alias("start"), F.posexplode(ids).alias("place", "id"))
    walk = feeds.related_walk(starts, edges, bound=WALK_BOUND, nodes=part.select(C("p_partkey").alias("id"), "p_size"), admits=(C("p_size") + C("start")) % 4 != 0)
    return walk.select("start", "id", "nth", (C("level") == 0).alias("own"), "admitted")


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 AND user_id % 2 = 0 THEN 'empty without proof' WHEN count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'purchase' AND value > 200) = 0 THEN 'all records invalid' END AS error FROM events GROUP BY 1")
def feed_verdicts(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    bought = C("event_type") == "purchase"
    results = events.groupBy("user_id").agg(F.count_if(bought).alias("fetched"), F.count_if(bought & (C("value") > 200)).alias("valid"), (F.first("user_id") % 2 != 0).alias("verified_empty"), F.first(F.lit(None).cast("string")).alias("error"))
    return feeds.verified_empty(results).select("user_id", "error")


@query("""SELECT o_orderkey AS release_id, CASE WHEN l.price IS NOT NULL THEN l.price ELSE o_totalprice END AS price, l.price IS NOT NULL AS changed FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderstatus != 'P'""")
def bucketed_store(spark, sf_dir):
    """All orders as a bucketed store, after one upsert and one deletion, each of which rewrites the buckets that it touches."""
    orders, items = tables(spark, sf_dir, "orders", "lineitem")
    store = upsert.BucketedTable(spark, scratch_path(spark, "store"), ["release_id"], 16)
    store.upsert(orders.select(C("o_orderkey").alias("release_id"), C("o_totalprice").alias("price"), F.lit(False).alias("changed")))
    prices = items.where("l_returnflag = 'R'").groupBy(C("l_orderkey").alias("release_id")).agg(F.max("l_extendedprice").alias("price")).withColumn("changed", F.lit(True))
    store.upsert(prices)
    store.delete(orders.where("o_orderstatus = 'P'").select(C("o_orderkey").alias("release_id")))
    return store.read()


@query("""SELECT o_orderstatus AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'moved' ELSE o_orderpriority END AS label, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS dear FROM orders WHERE o_orderstatus != 'P' AND o_orderdate >= '1996-01-01' GROUP BY 1, 2""")
def kept_counts(spark, sf_dir):
    """Counts by feed and label after a third of all releases changed their label, old ones expired and a feed was retired."""
    (orders,) = tables(spark, sf_dir, "orders")
    rows = orders.select(C("o_orderkey").alias("release_id"), C("o_orderstatus").alias("source"), C("o_orderpriority").alias("label"), C("o_totalprice").alias("price"), C("o_orderdate").alias("released"))
    store = upsert.BucketedTable(spark, scratch_path(spark, "store"), ["release_id"], 16)
    kept = counters.Counters(upsert.BucketedTable(spark, scratch_path(spark, "counts"), ["source", "label"], 8), {"n": F.lit(1), "dear": (C("price") > 100000).cast("int")})
    counters.counted_upsert(store, kept, rows)
    counters.counted_upsert(store, kept, rows.where("release_id % 3 = 0").withColumn("label", F.lit("moved")))
    counters.counted_delete(store, kept, upsert.expired(store.read(), "released", F.lit("1996-01-01").cast("timestamp"))[1])
    counters.counted_delete(store, kept, store.read().where("source = 'P'"))
    feeds.ensure(kept.drift(store.read()), F.lit("counts have drifted from the store"))
    return kept.read()


@query("SELECT s_suppkey, 'all' AS umbrella, s_suppkey % 4 = 0 AS missing FROM supplier")
def label_policies(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "supplier")
    rows = rows.select("s_suppkey", F.when(C("s_suppkey") % 4 != 0, C("s_name")).otherwise("").alias("label_id"))
    split = feeds.labelled(rows, "split").select("s_suppkey", C("label_identity_missing").alias("missing"))
    return feeds.labelled(rows, "umbrella", "all").select("s_suppkey", C("label_id").alias("umbrella")).join(split, "s_suppkey")


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def json_report(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "region")
    return feeds.json_lines(rows.select("r_regionkey", "r_name"))


@query("""SELECT o_custkey AS scan, count(*) AS pages, CASE WHEN o_custkey % 5 = 3 AND max(o_orderkey) > min(o_orderkey) THEN 'pages disagree about the last page' WHEN (count(*) + o_custkey % 2) > 12 THEN 'too many pages'
WHEN o_custkey % 2 = 1 OR o_custkey % 3 = 0 AND count(*) > 1 THEN 'pages are missing or repeated' END AS problem FROM orders GROUP BY o_custkey""")
def page_invariants(spark, sf_dir):
    """A customer's orders as the pages of one scan: some scans lack their last page, some have a page twice, some contradict themselves."""
    (orders,) = tables(spark, sf_dir, "orders")
    own = Window.partitionBy("o_custkey")
    n, nth = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy("o_orderkey"))
    page = F.when((C("o_custkey") % 3 == 0) & (nth == 2), 1).otherwise(nth)
    last = n + C("o_custkey") % 2 + F.when((C("o_custkey") % 5 == 3) & (nth == 1), -1).otherwise(0)
    # one page alone cannot disagree, so it says what its scan has
    last = F.when(n == 1, n + C("o_custkey") % 2).otherwise(last)
    return feeds.page_problems(orders.select(C("o_custkey").alias("scan"), page.alias("page"), last.alias("last_page")), ["scan"], most=12)


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 5 != 0 AND (o_orderkey - 1) % 5 = 0 AND o_orderkey != (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 5 != 0)")
def page_gaps(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return feeds.page_gaps(orders.where("o_orderkey % 5 != 0"), "o_orderkey")


@query("SELECT l_suppkey AS id, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem GROUP BY 1")
def cursor_records(spark, sf_dir):
    (items,) = tables(spark, sf_dir, "lineitem")
    walk = items.groupBy((C("l_orderkey") % 50).alias("cursor")).agg(F.when(F.max(C("l_orderkey") % 50) < 49, F.max(C("l_orderkey") % 50) + 1).alias("next_cursor"))
    feeds.whole_cursors(walk)
    return feeds.distinct_records(items.select(C("l_suppkey").alias("id"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("ordinal")), "id", "ordinal")


EVENT = "event_id long, user_id long, event_type string, at string, value double"


def event_rows(spark, sf_dir) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "value")


@query("SELECT event_id, user_id, value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-20 12:00:00' AND event_type != 'view'")
def feed_window(spark, sf_dir):
    """All events landed as a paged feed, and read up to the edges of a window."""
    folder = scratch_path(spark, "feed")
    landed.land(event_rows(spark, sf_dir), folder, "at", "event_id")
    rows = landed.feed(spark, folder, EVENT, date="at", key="event_id")
    return rows.where("at >= '2024-01-05' and at < '2024-01-20 12:00:00' and event_type != 'view'").select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, CASE WHEN ts < '2024-01-10' THEN 0 WHEN ts < '2024-01-20' THEN 1 ELSE 2 END::BIGINT AS batch FROM events")
def feed_growth(spark, sf_dir):
    """A feed that is scanned three times while it grows, as a stream: each batch has what its scan has that is new."""
    folder, out = scratch_path(spark, "scans"), scratch_path(spark, "stream")
    events, stream = event_rows(spark, sf_dir), landed.feed_stream(spark, folder, EVENT, date="at", key="event_id")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")  # a batch that is repeated replaces itself

    for scan, end in enumerate(("2024-01-10", "2024-01-20", "9999"), 1):
        landed.land(events.where(C("at") < end), f"{folder}/scan={scan}", "at", "event_id")
        cycle.run_cycle(stream, f"{out}/checkpoint", keep).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id", C("batch").cast("long").alias("batch"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 < 4 THEN 'new' ELSE 'old' END AS state FROM part")
def snapshot_refresh(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    listing = part.where("p_partkey % 10 < 6").select(C("p_partkey").alias("id"), F.lit("new").alias("state"), (C("p_partkey") % 10).alias("page"))
    old = part.where("p_partkey % 10 >= 4").select(C("p_partkey").alias("id"), F.lit("old").alias("state"))
    return feeds.refreshed(old, listing, "page", "id", False)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN k ELSE k + 1 END AS verify_failures, CASE WHEN l_returnflag = 'A' THEN '2024-01-02' ELSE '2024-01-01' END AS verified_at,
l_returnflag = 'R' AND k = 1 AS dead, CASE WHEN l_returnflag = 'R' AND k = 1 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'gone' ELSE 'Link not found' END END AS dead_reason FROM (SELECT *, l_linenumber % 2 AS k FROM lineitem)""")
def struck_links(spark, sf_dir):
    """One round over links with no strike or one: a live link alone counts as verified today."""
    (items,) = tables(spark, sf_dir, "lineitem")
    url = F.concat_ws("/", "l_partkey", "l_suppkey", "l_linenumber")
    none = F.lit(None)
    keys = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", C("l_orderkey").alias("release_id"), url.alias("url"))
    own = keys.select("release_id", "url", (C("l_linenumber") % 2).alias("verify_failures"), F.lit("2024-01-01").cast("timestamp").alias("verified_at"), none.cast("timestamp").alias("dead_at"), none.cast("string").alias("dead_reason")).dropDuplicates(["release_id", "url"])
    outcomes = keys.groupBy("release_id", "url").agg(F.max(F.when(C("l_returnflag") == "R", "dead").when(C("l_returnflag") == "A", "live").otherwise("inconclusive")).alias("outcome"), F.max(F.when(C("l_suppkey") % 2 == 0, "gone")).alias("reason"))
    out = links.struck(own, outcomes, F.lit("2024-01-02").cast("timestamp"))
    return keys.join(out, ["release_id", "url"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "verify_failures", F.date_format("verified_at", "yyyy-MM-dd").alias("verified_at"), C("dead_at").isNotNull().alias("dead"), "dead_reason")


@query("SELECT o_orderkey, CASE WHEN count(*) FILTER (l_returnflag != 'R') = 0 AND count(l_orderkey) > 0 THEN NULL ELSE o_orderstatus END AS checked_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def requeued_releases(spark, sf_dir):
    orders, items = tables(spark, sf_dir, "orders", "lineitem")
    checked = items.select(C("l_orderkey").alias("release_id"), F.when(C("l_returnflag") == "R", C("l_shipdate")).alias("dead_at"))
    return links.requeued(orders.select(C("o_orderkey").alias("release_id"), C("o_orderstatus").alias("checked_at")), checked).select(C("release_id").alias("o_orderkey"), "checked_at")


# --- listings


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 240")
def title_pages(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return readmodel.sorted_page(part.select("p_partkey", "p_name"), "title", "p_partkey", "p_name", "p_partkey", page=2)


@query("SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey = 3 AND s_acctbal <= 5000")
def label_errors(spark, sf_dir):
    (rows,) = tables(spark, sf_dir, "supplier")
    rows = readmodel.of_label(readmodel.of_label(rows, "s_nationkey", "all"), "s_nationkey", "3")
    return readmodel.feed_order(readmodel.errors_only(rows.withColumn("ok", C("s_acctbal") > 5000)).select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")


@query("""SELECT o_custkey AS label, n, o_orderkey AS record FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS nth FROM orders) WHERE nth <= 5""")
def diagnostic_samples(spark, sf_dir):
    """Per label how many observations there are, and the first five of them in order."""
    rows = order_observations(spark, sf_dir).withColumnRenamed("cluster", "label")
    return readmodel.samples(rows, "label").select("label", "n", "record")
