import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from almanac import schemas
from almanac.operators import coverage, dedupe, links, matching, reconcile, upsert
from almanac.sources import feeds
from almanac.streaming import cycle

D = datetime.date
T = datetime.datetime


def test_band_and_window_edges(spark):
    left = spark.createDataFrame([(1, D(2026, 3, 4), 100.0, 110.0)], "release_id int, released date, low double, high double")
    right = spark.createDataFrame(
        [("a", T(2026, 3, 3), 99.0), ("b", T(2026, 3, 11, 23, 59, 59), 111.0), ("c", T(2026, 3, 12), 105.0), ("d", T(2026, 3, 2, 23, 59), 105.0), ("e", T(2026, 3, 5), 98.9), ("f", None, 105.0), ("g", T(2026, 3, 5), None)],
        "url string, uploaded timestamp_ntz, duration double",
    )
    assert {r.url for r in matching.band_join(left, right).collect()} == {"a", "b"}
    assert {r.url for r in matching.band_join(left, right, days=None).collect()} == {"a", "b", "c", "d", "f"}
    assert {r.url for r in matching.band_join(left, right, tol=float("nan")).collect()} == {"a", "b"}
    plan = matching.band_join(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


PAIRS = [("r", "u1", "s1", 1, 5, 0), ("r", "u2", "s1", 1, 9, 3), ("r", "u3", "s2", 1, None, -1), ("r", "u4", "s3", 0, 99, 0), ("q", "u5", "s1", 0, None, 1), ("q", "u6", "s1", 0, 3, 2), ("q", "u7", "", 0, 8, 2)]


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_winner_does_not_depend_on_order(spark, order):
    rows = [PAIRS[i] for i in order] + PAIRS[4:]
    df = spark.createDataFrame(rows, "release_id string, url string, stem string, tier int, views int, lag int").repartition(3)
    got = {r.release_id: (r.url, r.fallback) for r in matching.winners(df).collect()}
    assert got == {"r": ("u2", False), "q": ("u6", True)}
    assert [r.url for r in matching.ranked(df).orderBy("place").collect()] == ["u2", "u3"]
    assert "WindowGroupLimit" in matching.winners(df)._jdf.queryExecution().executedPlan().toString()


def test_identity_tiers(spark):
    from almanac.functions.text import tokens

    rows = [("see big house now", 3), ("x1 code", 3), ("ann lee there", 2), ("ann there", 1), ("ann2024 there", 1), ("ann20245 there", 0), ("nothing", 0)]
    df = spark.createDataFrame(rows, "c string, t int")
    df = df.select("t", tokens(F.lit("Big House")).alias("title"), tokens(F.lit("X1")).alias("code"), F.array(tokens(F.lit("Ann Lee"))).alias("names"), tokens(F.col("c")).alias("candidate"))
    tier = matching.identity_tier(*(F.col(c) for c in ("title", "code", "names", "candidate")))
    assert all(r[0] == r[1] for r in df.select("t", tier).collect())


def test_multipart_is_all_or_nothing(spark):
    rows = [(1, "p", 10, 1), (1, "p", 20, 2), (2, "p", 10, 1), (2, "q", 20, 2), (3, "p", 10, 1), (3, "p", 10, 2), (4, None, 1, 1), (4, None, 2, 2), (5, "p", 1, 1)]
    df = spark.createDataFrame(rows, "k int, publisher string, duration int, number int")
    assert {(r.k, r.part) for r in matching.multipart(df, "k").collect()} == {(1, 1), (1, 2), (2, None), (3, None), (4, None), (5, None)}


def test_merge(spark):
    rows = [("c", "b", "1", "i1", 2, None, 10, D(2026, 1, 2), True, 0), ("c", "a", "1", "i2", 1, "", 12, D(2026, 1, 1), False, 3), ("d", "a", "1", "i3", 1, "x", 5, D(2026, 1, 1), False, 0), ("d", "a", "2", "i4", 1, "y", 6, D(2026, 1, 1), False, 0)]
    df = spark.createDataFrame(rows, "cluster string, provider string, record string, release_id string, priority int, title string, n int, released date, established boolean, live int")
    fields = {"title": "string", "n": "int", "released": "date"}
    out, ids = reconcile.reconciled(df.withColumn("titled", F.lit(True)), fields, duration="n", oldest="released")
    (r,) = out.collect()
    assert (r.title, r.n, r.n_min, r.n_max, r.n_review, r.n_from, r.providers, r.canonical_id) == (None, None, 10, 12, True, "a, b", 2, "i1")
    assert (r.lead_provider, r.lead_record, r.released, r.released_from) == ("a", "1", D(2026, 1, 1), "a")
    assert {tuple(x) for x in ids.collect()} == {("i1", "i1"), ("i2", "i1")}
    # two records of one provider merge under one URL, and a single one is a release
    out, ids = reconcile.reconciled(df.withColumn("linked", F.lit(True)), fields, priority={"title": ["b", "a"], "n": ["b"]})
    got = {r.cluster: (r.title, r.title_from, r.n, r.n_from, r.canonical_id) for r in out.collect()}
    assert got == {"c": (None, None, 10, "b", "i1"), "d": ("x", "a", 5, "a", "i3")}
    single = reconcile.reconciled(df.where("release_id = 'i3'"), fields)[0].collect()
    assert [(r.title, r.canonical_id) for r in single] == [("x", "i3")]
    # the oldest date counts where all are titled and agree on the duration
    same = df.where("cluster = 'c'").withColumns({"n": F.lit(7), "titled": F.lit(True), "released": F.date_sub("released", F.when(F.col("provider") == "b", 9).otherwise(0))})
    assert [(r.n, r.n_min, r.released, r.released_from) for r in reconcile.merged(same, fields, duration="n", oldest="released").collect()] == [(7, None, D(2025, 12, 24), "b")]
    assert [r.released_from for r in reconcile.merged(same.withColumn("titled", F.lit(False)), fields, duration="n", oldest="released").collect()] == ["a"]
    c = {r.cluster: (r.value, r.min_value, r.max_value, r.review) for r in reconcile.consensus(df, "cluster", "n").collect()}
    assert c == {"c": (None, 10, 12, True), "d": (None, 5, 6, False)}


def test_upserts_keep_and_repeat(spark):
    schema = "k int, a string, b array<string>, p map<string,string>"
    old = spark.createDataFrame([(1, "x", ["t"], {"a": "old", "z": "old"}), (2, "y", [], {})], schema)
    new = spark.createDataFrame([(1, "", [], {"a": "new"}), (3, "w", ["u"], {})], schema)
    once = upsert.upserted_keeping(old, new, ["k"], ["a", "b"], overlay="p")
    again = upsert.upserted_keeping(once, new, ["k"], ["a", "b"], overlay="p")
    rows = {r.k: (r.a, r.b, r.p) for r in once.collect()}
    assert rows == {1: ("x", ["t"], {"z": "old", "a": "new"}), 2: ("y", [], {}), 3: ("w", ["u"], {})}
    assert rows == {r.k: (r.a, r.b, r.p) for r in again.collect()}
    assert {r.k: r.a for r in upsert.upserted(old, new, ["k"]).collect()} == {1: "", 2: "y", 3: "w"}


def test_excluded_survivors(spark):
    releases = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "release_id string")
    observations = spark.createDataFrame([("p", 1, "r1"), ("q", 1, "r1"), ("p", 2, "r2")], "provider string, record int, release_id string")
    gone = spark.createDataFrame([("p", 1), ("p", 2)], "provider string, record int")
    kept, left = upsert.excluded(releases, observations, gone)
    assert {r[0] for r in kept.collect()} == {"r1", "r3"} and left.count() == 1


def test_versioned_table(spark, tmp_path):
    table = upsert.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.version() == 0
    table.write(spark.range(3))
    table.write(spark.range(5))
    assert table.version() == 2 and table.read().count() == 5
    (tmp_path / "t" / "v3").mkdir()  # a write that died before its pointer
    assert table.version() == 2 and table.read().count() == 5
    assert table.write(spark.range(7)) == 3 and table.read().count() == 7


def test_cycles_of_retention_and_snapshots(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, at timestamp, page int"
    kept, listed = upsert.VersionedTable(spark, str(tmp_path / "kept")), upsert.VersionedTable(spark, str(tmp_path / "listed"))
    for rows in ([(1, D(2026, 1, 1), 1), (2, D(2026, 1, 9), 1)], [(2, D(2026, 1, 10), 1), (3, D(2026, 1, 20), 1)]):
        spark.createDataFrame([(a, str(b), c) for a, b, c in rows], "id long, at string, page int").selectExpr("id", "cast(at as timestamp) at", "page").coalesce(1).write.mode("append").parquet(source)
        for name, apply in (("k", cycle.retention(kept, ["id"], "at", 15)), ("s", cycle.snapshots(listed, "page", "id"))):
            cycle.run_cycle(spark.readStream.schema(schema).parquet(source), str(tmp_path / name), apply).awaitTermination(120)
    assert {r.id for r in kept.read().collect()} == {2, 3} and {r.id for r in listed.read().collect()} == {1, 2, 3}


def test_streams_drop_repeats_and_count_windows(spark, tmp_path):
    source, out = str(tmp_path / "in"), {}
    spark.sql("select * from values (1, timestamp'2026-01-01 10:00', 'a'), (1, timestamp'2026-01-01 10:05', 'a'), (2, timestamp'2026-01-02 10:00', 'b'), (3, timestamp'2026-01-09 10:00', 'b') t(id, at, kind)").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id int, at timestamp, kind string").parquet(source)
    for name, df, mode in (("first", cycle.first_records(stream(), "id", "at"), "append"), ("windows", cycle.windowed_counts(stream(), "at", "kind"), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
        out[name] = spark.table(name).collect()
    assert sorted(r.id for r in out["first"]) == [1, 2, 3] and sorted((r["kind"], r.n) for r in out["windows"]) == [("a", 2), ("b", 1), ("b", 1)]


CHECKS = [(1, 1, "dead"), (1, 2, "inconclusive"), (1, 3, "dead"), (1, 4, "live"), (2, 1, "dead"), (2, 2, "live"), (2, 3, "dead"), (3, 1, "inconclusive"), (4, 1, "live")]
STATES = {1: (2, True, 3), 2: (1, False, None), 3: (0, False, None), 4: (0, False, None)}


def test_strikes_in_batch(spark):
    df = spark.createDataFrame(CHECKS, "link long, at long, outcome string").repartition(3)
    assert {r.link: (r.strikes, r.dead, r.dead_at) for r in links.folded(df).collect()} == STATES


def test_strikes_as_a_stream(spark, tmp_path):
    source, schema, got, due = str(tmp_path / "in"), "link long, at timestamp, outcome string", {}, []
    day = lambda n: T(2026, 1, n)

    def apply(batch, _):
        for r in batch.collect():
            if r.due_at is None:
                got[r.link] = (r.strikes, r.dead, r.dead_at and r.dead_at.day)
            else:
                due.append((r.link, r.due_at))

    for name, value in cycle.STORE.items():
        spark.conf.set(name, value)
    try:
        for at in (1, 2, 3, 4, 9):
            rows = [(link, day(n), outcome) for link, n, outcome in (CHECKS if at < 9 else [(7, 9, "live")]) if n == at]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = cycle.strike_states(spark.readStream.schema(schema).parquet(source))
            query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(apply).start()
            query.awaitTermination(120)
    finally:
        for name in cycle.STORE:
            spark.conf.unset(name)
    assert got == {**STATES, 7: (0, False, None)}
    # 1 died on day 3; 3 and 4 were checked on day 1 alone, 2 on days 1 to 3
    assert set(due) == {(3, day(2)), (4, day(2)), (2, day(4))}


@pytest.mark.parametrize("seed", range(6))
def test_strikes_of_a_batch_equal_the_loop(seed):
    import random

    import numpy as np

    rng = random.Random(seed)
    for _ in range(300):
        start, checks = rng.randint(0, 1), [rng.random() < 0.4 for _ in range(rng.randint(0, 8))]
        strikes, died = start, None
        for n, dead in enumerate(checks):
            strikes = strikes + 1 if dead else 0
            if strikes == links.STRIKES:
                died = n
                break
        found, when = cycle.struck(start, np.arange(len(checks)).astype("datetime64[us]"), np.array(checks, dtype=bool))
        assert (found, None if when is None else int(when.astype(int))) == (strikes, died)


def test_struck_and_requeued(spark):
    schema = "release_id string, url string, verify_failures int, verified_at timestamp, dead_at timestamp"
    rows = spark.createDataFrame([("r", "a", 1, None, None), ("r", "b", 0, None, None), ("s", "c", 1, None, None)], schema)
    outcomes = spark.createDataFrame([("r", "a", "dead"), ("r", "b", "live"), ("s", "c", "dead")], "release_id string, url string, outcome string")
    out = links.struck(rows, outcomes, F.lit("2026-03-10").cast("timestamp"))
    assert {r.url: (r.verify_failures, r.dead_at is not None) for r in out.collect()} == {"a": (2, True), "b": (0, False), "c": (2, True)}
    queue = links.requeued(spark.createDataFrame([("r", 1), ("s", 1)], "release_id string, checked_at int"), out)
    assert {r.release_id: r.checked_at for r in queue.collect()} == {"r": 1, "s": None}


def test_coverage_chain_is_not_transitive(spark):
    pairs = spark.createDataFrame([(1, "a", 2, "b"), (2, "b", 3, "c")], "id_1 long, provider_1 string, id_2 long, provider_2 string")
    groups = coverage.complete_groups(pairs).collect()
    assert {r.id: r.group for r in groups} == {1: 1, 2: 1, 3: 3}


def folded(pairs, providers):
    """Complete-link groups by definition: all pairs in order of provider and id."""
    rank = {p: i for i, p in enumerate(providers)}
    provider = {i: p for a, p, b, q in pairs for i, p in ((a, p), (b, q))}
    linked = {frozenset((a, b)) for a, _, b, _ in pairs}
    near = lambda x, p: [y for y in provider if provider[y] == p and frozenset((x, y)) in linked]
    groups = {x: {x} for x in provider}
    order = sorted(tuple(sorted(pair, key=lambda x: (rank[provider[x]], x))) for pair in linked)
    order.sort(key=lambda ab: [(rank[provider[x]], x) for x in ab])
    for a, b in order:
        if len(near(a, provider[b])) == len(near(b, provider[a])) == 1 and groups[a] is not groups[b] and all(frozenset((x, y)) in linked for x in groups[a] for y in groups[b]):
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    return {frozenset(g) for g in groups.values()}


def test_ambiguous_pairs_count_as_agreement(spark):
    """2 is paired with 3 and with 4, so neither pair joins groups, but 3 agrees with both 1 and 2."""
    rows = [(1, "a", 2, "b"), (1, "a", 3, "c"), (2, "b", 3, "c"), (2, "b", 4, "c")]
    pairs = spark.createDataFrame(rows, "id_1 long, provider_1 string, id_2 long, provider_2 string")
    assert {r.id: r.group for r in coverage.complete_groups(pairs).collect() if r.id < 4} == {1: 1, 2: 1, 3: 1}


def test_groups_equal_the_definition(spark):
    import random

    rng = random.Random(4)
    rows = sorted({(a, "abcd"[a % 4], b, "abcd"[b % 4]) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if "abcd"[a % 4] < "abcd"[b % 4]})
    pairs = spark.createDataFrame(rows, "id_1 long, provider_1 string, id_2 long, provider_2 string")
    for providers in ("abcd", "dbca"):
        found = {}
        for r in coverage.complete_groups(pairs, list(providers)).collect():
            found.setdefault(r.group, set()).add(r.id)
        want = {g for g in folded(rows, providers) if len(g) > 1}
        assert {frozenset(g) for g in found.values() if len(g) > 1} == want


def test_groups_of_dense_pairs_equal_the_definition(spark):
    """Cliques with holes over seven providers: groups grow over rounds, and holes keep them apart."""
    import random

    rng = random.Random(8)
    rows = [(7 * c + i, "abcdefg"[i], 7 * c + j, "abcdefg"[j]) for c in range(12) for i in range(7) for j in range(i + 1, 7) if rng.random() < (0.75 if c % 3 else 1.0)]
    pairs = spark.createDataFrame(rows, "id_1 long, provider_1 string, id_2 long, provider_2 string")
    found = {}
    for r in coverage.complete_groups(pairs).collect():
        found.setdefault(r.group, set()).add(r.id)
    assert {frozenset(g) for g in found.values()} == folded(rows, "abcdefg")
    assert all(name == min(g) for name, g in found.items()) and max(map(len, found.values())) == 7


def test_long_chains_are_one_component(spark):
    from almanac.operators.staging import connected

    edges = spark.createDataFrame([(i, i + 1) for i in range(150)], "a long, b long")
    assert {r.component for r in connected(edges).collect()} == {0}


def test_coverage_ambiguity_and_shares(spark):
    rows = [(1, "a", 10, ["x", "y", "z", "w", "v"]), (2, "b", 11, ["x", "y", "z", "w", "v"]), (3, "b", 12, ["x", "y", "z", "w", "v"]), (4, "a", None, ["q"]), (5, "b", 99, [])]
    df = spark.createDataFrame(rows, "id long, provider string, duration int, words array<string>")
    pairs = coverage.fuzzy_pairs(df, days=None)
    assert {(r.id_1, r.id_2) for r in pairs.collect()} == {(1, 2), (1, 3)}
    assert coverage.unambiguous(pairs).count() == 0
    none = spark.createDataFrame([], "id long, group long")
    assert {r.provider: (r.records, r.covered, r.share) for r in coverage.shares(df, none, ["a"]).collect()} == {"a": (2, 2, 0.4), "b": (3, 3, None)}


def test_hubs_and_chains(spark, monkeypatch):
    from almanac.operators import staging

    monkeypatch.setattr(staging, "HUB", 5)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(i, 500) for i in range(200, 240)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in staging.connected(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 100 for i in range(101, 140))
    assert all(got[i] == 200 for i in [*range(201, 240), 500]) and got[301] == 300 and len(got) == 30 + 39 + 40 + 1


def test_queue_limits(spark):
    rows = spark.range(5)
    assert [dedupe.capped(rows, [F.asc("id")], c).count() for c in (None, 0, -1, 2.9, 99)] == [5, 0, 0, 2, 5]
    assert [dedupe.recent(rows, "id", "id", n).count() for n in (None, 0, 3, 99)] == [5, 1, 3, 5]


def test_quarantine(spark):
    rows = spark.createDataFrame([("a", "t", None), ("", "t", None), ("b", "t", 0)], "id string, title string, duration int")
    good, bad = schemas.validated(rows, {"id is blank": "length(id) > 0", "duration is not positive": "duration is null or duration > 0"})
    assert [r.id for r in good.collect()] == ["a"] and {tuple(r.problems) for r in bad.collect()} == {("id is blank",), ("duration is not positive",)}
    empty = spark.createDataFrame([], schemas.RELEASES)
    assert schemas.validated(empty, schemas.RELEASE_RULES)[0].count() == 0


def test_feeds(spark, tmp_path):
    pages = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "page int, last_page int")
    assert feeds.whole_pages(pages).count() == 3
    for bad in ([(1, 3), (3, 3)], [(1, 2), (2, 3)], [(1, 2), (1, 2)]):
        with pytest.raises(feeds.FeedError):
            feeds.whole_pages(spark.createDataFrame(bad, "page int, last_page int"))
    with pytest.raises(feeds.FeedError):
        feeds.filter_applied(5, 5)
    snapshot = spark.createDataFrame([("b", 0), ("c", 0)], "id string, v int")
    listing = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("b", 1, 2), ("c", 1, 2), ("d", 1, 3)], "id string, v int, page int")
    assert {(r.id, r.v) for r in feeds.refreshed(snapshot, listing, "page", "id", False).collect()} == {("a", 1), ("b", 1), ("c", 0)}
    at = lambda day: F.lit(day).cast("timestamp")
    for last, rows, whole in ((None, {("a", 1), ("b", 1), ("c", 1), ("d", 1)}, True), ("2026-03-03", {("a", 1), ("b", 1), ("c", 1), ("d", 1)}, True), ("2026-03-04", {("a", 1), ("b", 1), ("c", 0)}, False)):
        found, full = feeds.refreshed_when_due(snapshot, listing, "page", "id", at(last), at("2026-03-10"))
        assert full is whole and {(r.id, r.v) for r in found.collect()} == rows
    with pytest.raises(feeds.FeedError):
        feeds.whole_cursors(spark.createDataFrame([("a", "b"), ("a", None)], "cursor string, next_cursor string"))
    cursors = lambda rows, **how: feeds.whole_cursors(spark.createDataFrame(rows, "cursor string, next_cursor string"), **how).count()
    assert cursors([("b", "c"), ("a", "b"), ("c", None)]) == 3 and cursors([]) == 0
    for bad in ([("a", None), ("b", "c"), ("c", "b")], [("a", "b"), ("b", "c")], [("a", "b"), ("b", "a")], [("a", "c"), ("b", "c"), ("c", None)]):
        with pytest.raises(feeds.FeedError):
            cursors(bad)
    with pytest.raises(feeds.FeedError):
        cursors([("a", "b"), ("b", None)], most=1)
    with pytest.raises(feeds.FeedError):
        feeds.search_union(spark.createDataFrame([(1, False)], "query int, ok boolean"), spark.createDataFrame([(1, "u", 1)], "query int, url string, ordinal int"))
    results = spark.createDataFrame([("a", 0, 0, False, None), ("b", 0, 0, True, None), ("c", 3, 0, False, None), ("d", 3, 1, False, None)], "f string, fetched int, valid int, verified_empty boolean, error string")
    assert {r.f: r.ok for r in feeds.verified_empty(results).collect()} == {"a": False, "b": True, "c": False, "d": True}
    (tmp_path / "in.json").write_text('{"scenes": [{"id": 1}, {"id": 2}]}')
    assert feeds.json_records(spark, str(tmp_path / "in.json"), "id: long", "scenes").count() == 2
    feeds.write_csv(spark.createDataFrame([('=1+"x"', 2)], "a string, b int"), str(tmp_path / "csv"))
    assert any('"\'=1+""x""","2"' in f.read_text() for f in (tmp_path / "csv").glob("*.csv"))
    starts = spark.createDataFrame([("s", 1, 1)], "start string, id int, place int")
    walk = feeds.related_walk(starts, spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1)], "id int, related int, place int"), bound=9)
    assert {(r.id, r.level) for r in walk.collect()} == {(1, 0), (2, 1), (3, 2)}
    posts = spark.createDataFrame([(1, [10, 11, 12])], "post int, attachments array<int>")
    media = spark.createDataFrame([(10, "video", True, None), (11, "image", True, None), (12, "video", True, 5)], "media_id int, kind string, accessible boolean, price int")
    assert [r.media_id for r in feeds.posts_with_media(posts, media).collect()] == [10]


def test_window_edge_scan(spark):
    rows = [(1, D(2026, 3, 9)), (1, D(2026, 3, 8)), (2, D(2026, 3, 7)), (2, D(2026, 3, 1)), (3, D(2026, 3, 8))]
    df = spark.createDataFrame(rows, "page int, d date")
    got = feeds.until_window_edge(df, "page", "d", F.lit("2026-03-05").cast("date"), size=2)
    assert {(r.page, r.d.day) for r in got.collect()} == {(1, 9), (1, 8), (2, 7)}


def queued(starts, edges, bound, admits):
    """The walk by definition: one queue a start."""
    out = []
    for start, first in starts.items():
        names = lambda i, without: list(dict.fromkeys(x for x in edges.get(i, []) if x not in without))
        queue, walked, followed = [], set(), 0
        for nth, i in enumerate(first, 1):
            out.append((start, i, 0, nth, admits(start, i)))
            if admits(start, i):
                walked.add(i)
                queue += [(x, 1) for x in names(i, {i})][: max(0, bound - len(queue))]
        while queue and followed < bound:
            i, level = queue.pop(0)
            if i in walked:
                continue
            walked.add(i)
            followed += 1
            out.append((start, i, level, followed, admits(start, i)))
            if admits(start, i):
                queue += [(x, level + 1) for x in names(i, walked)][: max(0, bound - followed - len(queue))]
    return sorted(out)


def test_walk_fills_its_budget_in_page_order(spark):
    import random

    from almanac.sources import feeds

    edges = {1: [2, 3, 4, 5, 6], 2: [7, 8], 7: [1]}
    frame = spark.createDataFrame([(a, b, n) for a, x in edges.items() for n, b in enumerate(x)], "id long, related long, place long")
    walk = feeds.related_walk(spark.createDataFrame([(0, 1, 0)], "start long, id long, place long"), frame, bound=3).where("level > 0")
    assert [(r.id, r.level) for r in walk.orderBy("nth").collect()] == [(2, 1), (3, 1), (4, 1)]
    rng = random.Random(6)
    edges = {i: [rng.randrange(30) for _ in range(rng.randrange(7))] for i in range(30)}
    starts = {s: rng.sample(range(30), rng.randint(1, 4)) for s in range(25)}
    frame = spark.createDataFrame([(a, b, n) for a, x in edges.items() for n, b in enumerate(x)], "id long, related long, place long")
    first = spark.createDataFrame([(s, i, n) for s, x in starts.items() for n, i in enumerate(x)], "start long, id long, place long")
    nodes = spark.createDataFrame([(i,) for i in range(28)], "id long")
    admits = lambda s, i: i < 28 and (s + i) % 5 != 0
    for bound in (0, 4, 11):
        got = feeds.related_walk(first, frame, bound=bound, nodes=nodes, admits=(F.col("start") + F.col("id")) % 5 != 0)
        assert sorted(tuple(r) for r in got.collect()) == queued(starts, edges, bound, admits)


def test_bucketed_store_rewrites_what_it_touches(spark, tmp_path):
    root = str(tmp_path / "store")
    store = upsert.BucketedTable(spark, root, ["k"], 8)
    assert store.read() is None and store.version() == 0
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v string")
    store.upsert(rows(range(100), "old"))
    before = store.manifest()["folders"]
    names = {b: sorted(p.name for p in (tmp_path / "store").glob(f"data-*/_bucket={b}/*.parquet")) for b in before}
    store.upsert(rows([5, 200], "new"))
    after = store.manifest()["folders"]
    moved = {b for b in before if before[b] != after[b]}
    assert 1 <= len(moved) <= 2 and len(before) == 8
    assert all(sorted(p.name for p in (tmp_path / "store").glob(f"data-*/_bucket={b}/*.parquet")) == names[b] for b in set(before) - moved)
    assert {r.k: r.v for r in store.read().collect()} == {**dict.fromkeys(range(100), "old"), 5: "new", 200: "new"}
    assert {r.k for r in store.lookup(rows([5, 7, 999], "")).collect()} == {5, 7}
    store.delete(rows([5, 6], ""))
    assert store.version() == 3 and {r.k for r in store.read().collect()} == {*range(100), 200} - {5, 6}
    with pytest.raises(ValueError):
        upsert.BucketedTable(spark, root, ["k"], 9).read()
    # a writer that comes second fails, and what it wrote never counts
    late = upsert.BucketedTable(spark, root, ["k"], 8)
    stale = late.manifest()
    store.upsert(rows([300], "first"))
    with pytest.raises(FileExistsError):
        late._replace(stale, [0], rows([400], "late"))
    assert {r.k for r in store.read().where("k >= 300").collect()} == {300}


def test_versions_of_two_writers(spark, tmp_path):
    table = upsert.VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3))
    with pytest.raises(FileExistsError):
        table._point(1, {"version": 1, "folder": "v-none"})
    assert table.read().count() == 3 and table.version() == 1


def test_search_by_postings(spark):
    from almanac.operators import postings, readmodel

    texts = ["The License applies", "no licence", "ALL the\nlicenses é", "", None, "li ce ns e", "the the the", "x" * 5000 + "license", "\U0001f600abc\U0001f600"]
    rows = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)] + [(0, "License again", "src"), (None, "license", "src")], "id long, text string, source string")
    index = postings.Index.of(rows, "id", ["text", "source"])
    for term in ("license", "LICENSE", "the", "th", "", "e\nlic", "zzz", "icensez", "\U0001f600abc", "src", "é s"):
        want = readmodel.searched(rows.where("id is not null"), term, ["text", "source"]).collect()
        assert sorted(r.key for r in index.search(term).collect()) == sorted(r.id for r in want)


@pytest.mark.parametrize("days", [None, 2])
def test_band_join_of_any_width(spark, days):
    import random

    rng = random.Random(3)
    ranges = [(i, D(2026, 3, rng.randint(1, 28)), low, low + rng.choice([0, 0.5, 3, 70, 5000, 1e6, 1e17, -9])) for i in range(60) for low in [round(rng.uniform(-50, 4000), 1)]]
    ranges += [(90, D(2026, 3, 3), None, 5.0), (91, D(2026, 3, 3), float("nan"), 5.0), (92, None, 1.0, 9.0), (93, D(2026, 3, 3), float("-inf"), float("inf"))]
    uploads = [(j, T(2026, 3, rng.randint(1, 28)), round(rng.uniform(-60, 9000), 1)) for j in range(80)] + [(90, None, 5.0), (91, T(2026, 3, 3), None), (92, T(2026, 3, 3), float("nan")), (93, T(2026, 3, 3), 1e12)]
    left = spark.createDataFrame(ranges, "r int, released date, low double, high double")
    right = spark.createDataFrame(uploads, "u int, uploaded timestamp_ntz, duration double")
    near = lambda a, b: days is None or a is not None and b is not None and T(a.year, a.month, a.day) - datetime.timedelta(days=1) <= b < T(a.year, a.month, a.day) + datetime.timedelta(days=days + 1)
    real = lambda *x: all(v is not None and v == v for v in x)
    want = {(r, u) for r, a, low, high in ranges for u, b, d in uploads if real(low, high, d) and low <= high and near(a, b) and low - 1 <= d <= high + 1}
    got = matching.band_join(left, right, days=days)
    pairs = [(r.r, r.u) for r in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_counters_follow_changes(spark, tmp_path):
    from almanac.operators import counters

    store = upsert.BucketedTable(spark, str(tmp_path / "s"), ["k"], 4)
    kept = counters.Counters(upsert.BucketedTable(spark, str(tmp_path / "c"), ["feed"], 4), {"n": F.lit(1), "live": F.col("live").cast("int")})
    rows = lambda *x: spark.createDataFrame(x, "k int, feed string, live boolean")
    read = lambda: {r.feed: (r.n, r.live) for r in kept.read().collect()}
    counters.counted_upsert(store, kept, rows((1, "a", True), (2, "a", False), (3, "b", True)))
    assert read() == {"a": (2, 1), "b": (1, 1)}
    counters.counted_upsert(store, kept, rows((1, "b", False), (4, "c", True)))
    assert read() == {"a": (1, 0), "b": (2, 1), "c": (1, 1)} and kept.drift(store.read()).isEmpty()
    counters.counted_delete(store, kept, rows((2, "", None), (9, "", None)))
    assert read() == {"b": (2, 1), "c": (1, 1)} and kept.drift(store.read()).isEmpty()
    assert [r.feed for r in kept.drift(rows((1, "b", False), (4, "c", True))).collect()] == ["b"]


def test_sessions_and_sliding_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select * from values (timestamp'2026-01-01 10:00', 'a'), (timestamp'2026-01-01 10:20', 'a'), (timestamp'2026-01-01 11:00', 'a'), (timestamp'2026-01-01 10:05', 'b'), (timestamp'2026-01-03 00:00', 'z') t(at, kind)").coalesce(1).write.parquet(source)
    batch = spark.read.parquet(source)
    for name, f in (("sessions", lambda x: cycle.session_counts(x, "at", "kind")), ("sliding", lambda x: cycle.windowed_counts(x, "at", "kind", "1 hour", "1 hour", "30 minutes"))):
        query = f(spark.readStream.schema("at timestamp, kind string").parquet(source)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows = lambda x: {(r.window.start, r.window.end, r["kind"], r.n) for r in x.collect() if r["kind"] != "z"}
        assert rows(spark.table(name)) == rows(f(batch)) and len(rows(f(batch))) > 2
    late = cycle.session_counts(batch, "at", "kind").where("kind = 'a'")
    assert sorted(r.n for r in late.collect()) == [1, 2]


def test_records_become_releases(spark):
    from almanac.operators import projection

    feeds_ = spark.createDataFrame([("f", "Feed")], "source_id string, name string")
    records = spark.createDataFrame([("f", "1", "T", None), ("g", "2", None, "C-1"), ("f", "3", "", "")], "source_id string, record_id string, title string, code string")
    previous = spark.createDataFrame([("f:1", ["u"], T(2026, 1, 1)), ("f:9", ["v"], T(2026, 1, 1))], "release_id string, links array<string>, checked_at timestamp")
    now = F.lit("2026-03-10").cast("timestamp")
    got = {r.release_id: r for r in projection.releases_of(records, feeds_, previous, now).collect()}
    assert set(got) == {"f:1", "g:2", "f:3"}
    one, two = got["f:1"], got["g:2"]
    assert (one.source, one.label, one.label_id, one.links, one.checked_at, one.dead_links, one.tags, one.poster_url, one.duration_review) == ("Feed", "Feed", "f", ["u"], T(2026, 1, 1), [], [], "", False)
    assert (two.source, two.links, two.checked_at, two.title, two.code, got["f:3"].code, got["f:3"].title, one.field_provenance) == ("g", [], None, None, "C-1", None, "", {})
    assert [tuple(x) for x in one.provenance] == [("Feed", T(2026, 3, 10), None, None, "1")]
    assert projection.releases_of(records.limit(0), feeds_, previous, now).count() == 0
