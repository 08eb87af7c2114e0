import pytest
from pyspark.sql import functions as F

from almanac.functions import classify, parse, text, urls


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "value, tokens",
    [("Ｆｕｌｌ ﬁne Éclair № 5", ["full", "fine", "eclair", "no", "5"]), ("cafÃ©", ["cafe"]), ("naïve café", ["naive", "cafe"]), ("日本", []), (None, []), ("é combining", ["e", "combining"])],
)
def test_tokens(spark, value, tokens):
    assert one(spark, text.tokens, value) == tokens


@pytest.mark.parametrize("value, to", [("cafÃ©", "café"), ("café", "café"), ("plain", "plain"), ("Ã", "Ã"), (None, None), ("Ł Ã©", "Ł Ã©")])
def test_mojibake(spark, value, to):
    assert one(spark, text.mojibake_repaired, value) == to


@pytest.mark.parametrize(
    "value, stem",
    [("{new} Big House https://x.y/z #tag #two", "big house"), ("House 2024-03-04 watch Full HD download", "house full hd"), ("", ""), ("#only", "only"), ("Clip 24.03.04 end", "clip end"),
     ("a 24.13.04 b", "a 24 13 04 b"), ("x2024-03-04 y", "x2024 03 04 y"), ("12 24.03.04 z", "12 z"), ("1999/1/99 z", "z"), ("24.03.045", "24 03 045"), ("a{x {Watch/Download: q} b", "a x b"), ("t #a #b-c  ", "t"), ("#a t", "a t")],
)
def test_title_stem(spark, value, stem):
    assert one(spark, text.title_stem, value) == stem


def test_patterns_of_a_title_wait_for_their_marks(spark):
    """A title without an address, a notice or a hashtag meets none of their patterns; one with them loses them, in any case."""
    rows = [("plain words", "plain words"), ("see HTTP://x.org/a#b now", "see   now"), ("a {NEW x} b", "a   b"), ("a {other} b", "a {other} b"), ("so #one #two ", "so "), ("#one so", "#one so"), (None, "")]
    df = spark.createDataFrame(rows, "t string, want string").select("want", text.unwrapped(F.col("t")).alias("got"))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []
    plan = df._jdf.queryExecution().analyzed().toString()
    assert all(f", {mark})" in plan for mark in ("://", "{", "#"))


@pytest.mark.parametrize("value, code", [("12345", "12345"), ("REL-NO-98765 extra", "98765"), ("https://x.y/articles/4567", "4567"), ("rel 12", None), (None, None)])
def test_release_code(spark, value, code):
    assert one(spark, text.release_code, value) == code


@pytest.mark.parametrize("value, part", [("Show part 2", 2), ("Show part 2 and part 3", None), ("[4979341]_3 x", None), ("4979341-3", 3), ("動画パート 4", 4), ("none", None), ("Part [.- 7]", 7), ("part . 7 -", 7), ("part . - 7", None), ("part 07", None), ("depart 3", None), ("part 3x", None), ("4979341 - 5)", 5), ("24979341-3", None), ("4979341-3x", None), ("part 2, part 2", 2)])
def test_part_number(spark, value, part):
    assert one(spark, lambda x: text.part_number(x, F.lit("4979341")), value) == part


def test_has_code(spark):
    for value, there in (("REL-4979341", True), ("14979341", False), ("49793410", False), ("x4979341y", True)):
        assert one(spark, lambda x: text.has_code(x, F.lit("4979341")), value) is there


def test_snippet(spark):
    long = "a" * 200 + " needle " + "b" * 200
    cut = one(spark, lambda x: text.snippet(x, F.array(F.lit("needle"))), long)
    assert cut.startswith("…") and cut.endswith("…") and "needle" in cut and len(cut) <= 182
    assert one(spark, lambda x: text.snippet(x, F.array(F.lit("none"))), "short") == "short"


def test_names(spark):
    assert one(spark, text.contributor_name, "Ann Lee LS") == "ann lee"
    assert one(spark, text.contributor_name, "") == ""
    assert one(spark, text.display_name, "big-red_house") == "Big Red House"
    assert one(spark, text.slug, "--Big, Red!") == "big-red"
    assert one(spark, parse.split_names, "Ann, Bob and Cyd & Dee,") == ["Ann", "Bob", "Cyd", "Dee"]


def test_redacted_error(spark):
    for value, to in (
        ("Bearer abc.def failed", "Bearer [redacted] failed"),
        ("GET https://u:p@x.y/?api_key=1&b=2", "GET https://[redacted]@x.y/?api_key=[redacted]&b=2"),
        ("HTTP 500 <html>secret", "HTTP 500 [response body omitted]"),
        ('bad {"token": 1}', "bad [response body omitted]"),
        ("see  x?Token=1#f&auth=2&x=3 bearer  abc", "see  x?Token=[redacted]#f&auth=[redacted]&x=3 Bearer [redacted]"),
        ("http://a@b.c https://d:e@f.g/?h=1", "http://[redacted]@b.c https://[redacted]@f.g/?h=1"),
    ):
        assert one(spark, text.redacted_error, value) == to
    assert len(one(spark, text.redacted_error, "x" * 999)) == 240
    assert one(spark, lambda x: text.redacted_error(x, ["s3cret", ""]), "key s3cret <b>s3cret") == "key [redacted] [response body omitted]"


def test_scene_code(spark):
    code = lambda x: text.scene_code(x, F.lit("mine"), {"mine": r"\bOB\d{3,}\b"})
    assert [one(spark, code, x) for x in ("See OB123 here", "OB12", None)] == ["ob123", None, None]
    assert one(spark, lambda x: text.scene_code(x, F.lit("other"), {"mine": "OB"}), "OB123") is None


@pytest.mark.parametrize("value, seconds", [("4:05", 245), ("1:02:03", 3723), ("4:60", None), ("0:00", None), ("x", None), (None, None)])
def test_clock(spark, value, seconds):
    assert one(spark, parse.clock_seconds, value) == seconds


@pytest.mark.parametrize("value, seconds", [("PT1H2M3S", 3723), ("P1DT1S", 86401), ("1h 20m", 4800), ("90", 90), ("02:03", 123), ("1.5 minutes", 90), ("", None), ("PT0S", None), ("PT", None), ("P1DT2H", 93600), ("PT3M2H", 7200), ("1:2:03", 3723), ("1:2:3", None), ("70:05", 4205), ("2 hrs 5 secs", 7205), ("5h2m", 120), ("1.5h", 5400), ("3 hoursx", None), ("pt1.5s", 2)])
def test_duration(spark, value, seconds):
    assert one(spark, parse.duration_seconds, value) == seconds


@pytest.mark.parametrize("value, views", [("1,234 views", 1234.0), ("12k", 12000.0), ("1.2M", 1200000.0), ("many", None), ("", None), (None, None)])
def test_views(spark, value, views):
    assert one(spark, parse.view_count, value) == views


@pytest.mark.parametrize(
    "value, at",
    [("2026-03-05 10:00:00", "2026-03-05 10:00:00"), ("2026-03-05T10:00", "2026-03-05 10:00:00"), ("2026-03-05", "2026-03-05 00:00:00"), ("2026-03-05T10:00:00+02:00", "2026-03-05 08:00:00"), ("2026-19-05", None), ("2026-02-30 10:00:00", None), ("soon", None)],
)
def test_timestamps(spark, value, at):
    assert one(spark, lambda x: F.date_format(parse.parsed_timestamp(x), "yyyy-MM-dd HH:mm:ss"), value) == at


def test_times_do_not_move_with_the_session(spark):
    texts = ["2024-05-03 11:20:00", "2024-05-03T11:20", "2024-05-03", "2024-05-03T11:20:00.500", "2024-05-03T11:20+0200", "2024-05-03T11:20:00-05:00", "2024-05-03T11:20:00z", "2024-03-10T02:30:00Z", "2024-05-03 24:00", "2024-13-01", "x"]
    want = ["2024-05-03T11:20:00.000Z", "2024-05-03T11:20:00.000Z", "2024-05-03T00:00:00.000Z", "2024-05-03T11:20:00.500Z", "2024-05-03T09:20:00.000Z", "2024-05-03T16:20:00.000Z", "2024-05-03T11:20:00.000Z", "2024-03-10T02:30:00.000Z", None, None, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r[0] for r in df.orderBy("i").select(parse.iso_utc(parse.parsed_timestamp(F.col("x")))).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_html(spark):
    assert one(spark, parse.html_text, "<p>a&amp;lt;b &#39;c&#x41; &#xD800;&nbsp;d</p><script>x</script>") == "a<b 'cA d"
    assert one(spark, parse.html_text, None) == ""
    page = '<script type="text/javascript">x</script><script data-page="app" type="application/json">{"props":{"articles":{"data":[{"id":1}]}}}</script>'
    assert one(spark, parse.embedded_json, page) == '{"props":{"articles":{"data":[{"id":1}]}}}'
    assert one(spark, parse.embedded_json, '<script data-page="a" type="application/json">{&quot;a&quot;: 1}</script>') == '{"a": 1}'
    assert one(spark, parse.embedded_json, '<script data-page="a" type="application/json">{broken</script>') is None
    assert one(spark, parse.canonical_url, '<link href="https://x.y/a" rel="canonical">') == "https://x.y/a"
    assert one(spark, parse.canonical_url, '<meta content="https://x.y/b" property="og:url">') == "https://x.y/b"
    block = '<!-- <li class="vit-uploader"><a href="/profile/no/1">x</a></li> --><li class="a vit-uploader b"><a href="/profile/Ann.Lee/2">y</a></li>'
    assert one(spark, parse.block_account, block) == "Ann.Lee"
    assert one(spark, parse.page_seconds, '<meta content="95" property="og:duration">') == 95
    recipes = {"x.y": {"title": r"<b>(.*?)</b>", "date": r"<i>(.*?)</i>"}}
    fill = lambda x: F.to_json(F.struct(*(c.alias(k) for k, c in parse.filled_by_recipe(x, F.lit("x.y"), recipes, {"title": F.lit("kept"), "date": F.lit(""), "other": F.lit("")}).items())))
    assert one(spark, fill, "<b>new</b><i>2024 &amp; on</i>") == '{"title":"kept","date":"2024 & on"}'
    assert one(spark, parse.meta_tags, '<meta name="a" content="1"><meta content="2" property="a">') == {"a": "1"}


@pytest.mark.parametrize(
    "value, identity",
    [("https://X.com/a/12/It's-Ok/?q=1#z", "x.com/a/12/itsok?q=1"), ("http://x.com/a/", "x.com/a"), ("Not A Url", "not a url"), ("  ", None), (None, None), ("https://x.com/12", "x.com/12"),
     ("https://u:p@x.org:443/a", "x.org/a"), ("http://x.org:80/a", "x.org/a"), ("http://x.org:443/a", "x.org:443/a"), ("https://x.org/b/./c/../../a/", "x.org/a"), ("https://x.org/../a/%2E%2e/b?", "x.org/b"), ("https://x.org", "x.org"), ("https://x.org:/a//", "x.org/a")],
)
def test_url_identity(spark, value, identity):
    assert one(spark, urls.url_identity, value) == identity


def test_url_shapes(spark):
    shape = lambda x: urls.has_shape(x, "x.com", r"/v/[a-z0-9]+")
    assert one(spark, shape, "https://x.com/v/ab1") is True
    for bad in ("http://x.com/v/ab1", "https://x.com:1/v/ab1", "https://x.com/v/ab1?q", "https://x.com/v/ab1#f", None):
        assert one(spark, shape, bad) is False
    host = lambda x: urls.allowed_host(x, ["x.com"])
    assert [one(spark, host, u) for u in ("https://a.x.com/1", "https://evilx.com/", "http://x.com/", "https://127.0.0.1/")] == [False, False, False, False]
    for url, fit in (("https://x.com/1", True), ("HTTPS://WWW.X.com:443", True), ("https://x.com:8443/", False), ("https://u:p@x.com/", False), ("https://u@x.com", False), (None, False), ("x.com", False), ("https://x.com.evil.org/", False)):
        assert one(spark, host, url) is fit
    private = [one(spark, urls.private_host, x) for x in ("127.0.0.1", "10.9.9.9", "172.31.0.1", "172.32.0.1", "192.168.1.1", "169.254.1.1", "224.0.0.1", "255.1.1.1", "8.8.8.8", "localhost", "[::1]", "fe80::1", "x.com")]
    assert private == [True, True, True, False, True, True, True, True, False, True, True, True, False]
    assert one(spark, lambda x: urls.same_page(x, F.lit("https://X.com/a/")), "http://x.com/A") is True
    assert one(spark, urls.loose_url, "HTTPS://X.com:8/A/?q") == "x.com/a"


def test_cascade_order(spark):
    rules = classify.Cascade(safety=[("s", "danger")], positive=[("p", "good")], review=[("r", "maybe")], exclude=[("e", "bad")], strong=[("t", "very")])
    got = {x: one(spark, lambda c: F.to_json(classify.decided(c, rules)), x) for x in ("danger good", "none", "good bad", "good maybe", "good", "very good")}
    for x, decision, reason in (("danger good", "excluded", "safety"), ("none", "excluded", "no evidence"), ("good bad", "excluded", "e"), ("good maybe", "review", "review"), ("good", "excluded", "no strong evidence")):
        assert f'"decision":"{decision}","reason":"{reason}"' in got[x]
    assert '"decision":"admit"' in got["very good"]
    with pytest.raises(ValueError):
        classify.Cascade(safety=[], positive=[])


def test_outcomes(spark):
    rows = [("page", 404, None, ""), ("page", 200, None, ""), ("page", 503, None, ""), ("api", 200, "application/json", "[]"), ("api", 200, "text/html", "[]"), ("api", 200, "application/json", "{"), ("api", 200, None, '{"id":"ab"}'), ("api", None, None, None)]
    rows += [("api", 200, "application/json", x) for x in ('[{"id":"ab"},{"id":"c"}]', '{"id":"other"}', '[{"id":"c"},{"id":"ab"}]', '{"id":1}', '{"name":"ab"}', '["ab"]', '[["ab"]]', "3", "[ ]")]
    df = spark.createDataFrame(rows, "k string, s int, t string, b string").withColumn("r", F.lit("ab"))
    got = [r[0] for r in df.select(classify.link_outcome(*(F.col(c) for c in "kstbr"))).collect()]
    assert got == ["dead", "live", "inconclusive", "dead", "inconclusive", "inconclusive", "live", "inconclusive", "live", *["inconclusive"] * 7, "dead"]
    assert [one(spark, lambda x: classify.link_outcome(F.lit("api"), F.lit(200), F.lit(""), x, F.lit("1")), x) for x in ('{"id":1}', '{"id":"1"}')] == ["inconclusive", "live"]
    assert [one(spark, classify.error_class, x) for x in (None, "API key missing", "not implemented", "HTTP 500", "HTTP 403")] == ["ok", "config", "unimplemented", "failing", "config"]
    said = {"token. missing": "failing", "missing the api keyring": "config", "keys are required": "config", "required keys": "failing", "monkey missing": "failing", "ENV variable X": "config", "env  variable X": "config", "myenv variable": "failing", "Not implemented yet": "unimplemented", "tokens expired": "config"}
    assert {x: one(spark, classify.error_class, x) for x in said} == said
