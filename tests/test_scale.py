"""What must not grow with the square of the input: queries over tables that are repeated under other keys."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from almanac import plans
from almanac.operators import coverage, matching

SHIFT = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "part": ["p_partkey"]}


@pytest.fixture(scope="module")
def thrice(tmp_path_factory):
    """Orders, line items and parts of the small tables, each three times."""
    folder = tmp_path_factory.mktemp("thrice")
    for name, keys in SHIFT.items():
        moved = ", ".join(f"{k} + i * 1000000 AS {k}" for k in keys)
        duckdb.sql(f"COPY (SELECT * REPLACE ({moved}) FROM '/root/testdata/sf0.01/{name}.parquet', range(3) r(i)) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name, times", [("views_ranking", 3), ("ranked_candidates", 1), ("ranked_winner", 1), ("resolve_releases", 1), ("tier_histogram", 1)])
def test_copies_are_not_paired_with_copies(spark, monkeypatch, thrice, name, times):
    """Releases that are alike meet their candidates once; only a list of all pairs holds all candidates."""
    join, met = matching.band_join, []

    def counted(*args, **named):
        pairs = join(*args, **named)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(matching, "band_join", counted)
    plans.QUERIES[name](spark, "/root/testdata/sf0.01")
    got = plans.QUERIES[name](spark, thrice)
    assert met[1] == times * met[0] > 0
    con = duckdb.connect()
    for table in SHIFT:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{thrice}/{table}.parquet'")
    sql = con.sql(plans.ORACLE_SQL[name])
    assert sorted(map(tuple, got.select(sql.columns).collect()), key=repr) == sorted(sql.fetchall(), key=repr)


def test_ranges_of_all_widths_share_few_levels(spark):
    """Candidates are entered once a level, so levels must be few; releases fall into nine buckets at most."""
    left = spark.range(40).select("id", F.lit("2026-03-03").cast("date").alias("released"), F.lit(7.0).alias("low"), (F.lit(7.0) + F.pow(F.lit(2.0), F.col("id"))).alias("high"))
    right = spark.range(5).select(F.lit("2026-03-03").cast("timestamp").alias("uploaded"), (F.col("id") * 1000.0).alias("duration"))
    got = matching.band_join(left, right)
    (levels,) = re.findall(r"explode\(cast\(array\(([^)]*)\)", got._jdf.queryExecution().analyzed().toString())
    assert len(levels.split(",")) <= 20
    assert got.count() == sum(7 - 1 <= 1000 * j <= 7 + 2**i + 1 for i in range(40) for j in range(5))


def test_copies_meet_once_and_all_pairs_come(spark, monkeypatch):
    """Copies within a provider are compared once for all; pairs are those of the definition, rare words or not."""
    import random

    rng = random.Random(5)
    texts = [sorted(rng.sample([f"w{i}" for i in range(40)], 18)) for _ in range(12)]
    texts += [t[:-1] + ["own" + t[0]] for t in texts]
    rows = [(i, "abc"[i % 3], 50 + i % 5, texts[rng.randrange(24)]) for i in range(90)] + [(90 + i, "d", 51, texts[0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, provider string, duration int, words array<string>")
    near = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] < b[1] and abs(a[2] - b[2]) <= 3 and near(a[3], b[3]))
    kept, stage = {}, coverage.staged
    monkeypatch.setattr(coverage, "staged", lambda df, name: kept.setdefault(name, stage(df, name)))
    for frequent in (20_000, 5):
        kept.clear()
        monkeypatch.setattr(coverage, "FREQUENT", frequent)
        got = sorted((r.id_1, r.id_2) for r in coverage.fuzzy_pairs(df, days=None).collect())
        assert got == want
        assert kept["keyed"].where("provider = 'd'").select("id").distinct().count() == 1


def test_words_follow_only_where_enough_rare_ones_are_shared(spark, monkeypatch):
    """One rare word in common does not bring the words of two records together, whatever the order; short records count by what they must share."""
    import random

    rng = random.Random(7)
    shared = [f"rare{i}" for i in range(30)]
    rows = [(i, "ab"[i % 2], 90, [f"w{i}-{j}" for j in range(60)] + rng.sample(shared, 2)) for i in range(60)]
    rows += [(100 + i, "ab"[i % 2], 90, rows[i // 2][3][:56] + [f"v{i}-{j}" for j in range(3)]) for i in range(20)]
    rows += [(200 + n * 2 + i, "ab"[i], 90, [f"s{n}-{j}" for j in range(n)] + (["x"] if i else [])) for n in range(1, 9) for i in range(2)]
    df = spark.createDataFrame(rows, "id long, provider string, duration int, words array<string>")
    near = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] < b[1] and near(a[3], b[3]))
    kept, stage = {}, coverage.staged
    monkeypatch.setattr(coverage, "staged", lambda df, name: kept.setdefault(name, stage(df, name)))
    for frequent in (20_000, 5):
        kept.clear()
        monkeypatch.setattr(coverage, "FREQUENT", frequent)
        assert sorted((r.id_1, r.id_2) for r in coverage.fuzzy_pairs(df, days=None).collect()) == want
        assert len(want) <= kept["met"].count() <= len(want) + 5


def test_part_numbers_are_read_once(spark, small):
    """Parts are told from all candidates of a release; their titles are not read again for that."""
    assert "regexp" not in plans.QUERIES["exact_code_lane"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["ranked_winner", "resolve_releases", "match_telemetry", "playback_status"])
def test_winners_move_no_pairs(spark, small, name):
    """Pairs grow with the square of a table: of each release's only the smallest number leaves the join, so none is sorted or staged."""
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    (pairs,) = [i for i, x in enumerate(lines) if "Join" in x and "_band" in x]
    assert "Project" in lines[pairs - 1] and "partial_min(number" in lines[pairs - 2] and " HashAggregate" in lines[pairs - 2]
    assert "Window" not in plan


def test_winners_in_bands_are_the_winners_of_all_pairs(spark):
    """One order of the candidates gives what ranking all pairs gives, whatever is missing or alike."""
    import datetime as dt
    import random

    rng = random.Random(11)
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    left = [(i, day(rng.randrange(20)) if rng.random() < 0.95 else None, float(low := rng.randrange(1, 60)) if rng.random() < 0.95 else None, float(low + rng.randrange(3))) for i in range(150)]
    right = [(f"u{i}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(480)) if rng.random() < 0.95 else None, float(rng.randrange(60)) if rng.random() < 0.95 else None, rng.choice([0, 0, 0, 1, 2, None]), rng.choice([None, 5, 7]), rng.choice(["a", "b", "", None])) for i in range(120)]
    releases = spark.createDataFrame(left, "release_id long, released date, low double, high double")
    candidates = spark.createDataFrame(right, "url string, uploaded timestamp, duration double, tier int, views long, stem string")
    columns = ["release_id", "url", "tier", "views", "lag", "fallback"]
    by = ["released", "low", "high"]
    pairs = matching.band_join(releases, candidates).withColumn("lag", F.datediff("uploaded", "released").cast("long"))
    want = sorted(map(tuple, matching.winners(pairs).select(columns).collect()))
    got = matching.for_each(releases, matching.winners_in_bands(releases, candidates, *by), *by)
    assert sorted(map(tuple, got.select(columns).collect())) == want
    assert {r[-1] for r in want} == {True, False} and len(want) > 50


def test_postings_stay_beside_their_texts(spark, monkeypatch):
    """Postings, many times as many rows as texts, are neither dealt out by gram nor made twice for that; hashes that meet lose nothing."""
    from almanac.operators import postings

    made, stage = {}, postings.staged
    monkeypatch.setattr(postings, "staged", lambda df, name: made.setdefault(name, df) and stage(df, name))
    rows = spark.createDataFrame([(i, f"text number {i} of many") for i in range(300)], "id long, text string")
    index = postings.Index.of(rows, "id", ["text"])
    assert "Exchange" not in made["postings"]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(postings.F, "xxhash64", lambda *x: F.lit(7).cast("long"))
    met = postings.Index.of(rows, "id", ["text"])
    assert sorted(r.key for r in met.search("number 29").collect()) == [29, *range(290, 300)]
    monkeypatch.undo()
    assert sorted(r.key for r in index.search("number 29").collect()) == [29, *range(290, 300)]


def test_views_are_ranked_where_pairs_meet(spark, small):
    """Nothing is dealt out anew above the join that makes all pairs."""
    plan = plans.QUERIES["views_ranking"](spark, small)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    (pairs,) = [i for i, x in enumerate(lines) if "Join" in x and "_band" in x]
    assert any("Window" in x for x in lines[:pairs]) and not any("Exchange" in x for x in lines[:pairs])


@pytest.mark.parametrize("days", [2, 7])
def test_pairs_that_stay_together(spark, monkeypatch, days):
    """The same pairs come when each release has one bucket, for ranges of all widths, and in more partitions when they are many."""
    import random

    rng = random.Random(3)
    left = spark.createDataFrame([(i, f"2026-01-{rng.randrange(1, 29):02}", float(low := rng.randrange(400)), low + rng.choice([0.0, 1.5, 20.0, 90.0, 2000.0])) for i in range(120)], "release_id long, released string, low double, high double").withColumn("released", F.to_date("released"))
    right = spark.createDataFrame([(f"u{i}", f"2026-01-{rng.randrange(1, 31):02} 0{rng.randrange(10)}:00:00", rng.randrange(8000) / 10) for i in range(300)], "url string, uploaded string, duration double").withColumn("uploaded", F.to_timestamp("uploaded"))
    want = sorted(map(tuple, matching.band_join(left, right, days=days).select("release_id", "url").collect()))
    monkeypatch.setattr(matching, "PART_PAIRS", 50)
    got = matching.band_join(left, right, days=days, together=True)
    assert got.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, got.select("release_id", "url").collect())) == want and len(want) > 500
    assert got.select("release_id", *matching.BUCKET).distinct().count() == len({x[0] for x in want})


def test_statuses_need_no_order_of_uploads(spark, small, monkeypatch):
    """A status asks only whether some upload is named: no upload is numbered or staged for that, nor is its address read."""
    staged = []
    monkeypatch.setattr(matching, "staged", lambda df, name: staged.append(name) or df)
    plan = plans.QUERIES["playback_status"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not staged and "l_linenumber" not in plan and "l_quantity" not in plan


def test_entries_of_a_bucket_are_bounded(spark, monkeypatch):
    """However many uploads are near a release, those that it meets are bounded by days and stretches; its least number comes."""
    import datetime as dt
    import random

    rng = random.Random(13)
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    left = [(i, day(rng.randrange(12)), float(low := rng.randrange(80)), low + rng.choice([0.0, 3.5, 20.0])) for i in range(60)]
    right = [(dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(288)), rng.randrange(1000) / 10, rng.choice([0, 0, 1, 1, 1, 2]) if i % 7 else None) for i in range(6000)]
    right += [(dt.datetime(2026, 1, 3), x, 0) for x in (1e300, float("inf"), -1e17)]
    left += [(60, day(2), 9e299, 2e300), (61, day(2), -1e17, -1e17), (62, day(2), 1e301, 1e301)]
    releases = spark.createDataFrame(left, "release_id long, released date, low double, high double")
    candidates = spark.createDataFrame(right, "uploaded timestamp, duration double, tier int").selectExpr("*", "'s' AS stem")
    by = ["released", "low", "high"]
    for tol in (4.0, 0.0):
        near = [(r, t) for *r, low, high in left for u, d, t in right if -1 <= (u.date() - r[1]).days <= 7 and max(low - d, d - high) <= tol]
        want = {r[0]: True for r, _ in near} | {r[0]: False for r, t in near if t}
        join, met = matching.band_join, []
        with monkeypatch.context() as m:
            m.setattr(matching, "band_join", lambda *x, **y: met.append(join(*x, **y)) or met[0])
            found = matching.fallbacks_in_bands(releases, candidates, *by, tol=tol)
        got = {r.release_id: r.fallback for r in matching.for_each(releases, found, *by).collect()}
        assert got == want and 60 in got and 61 in got and 62 not in got
        if tol:
            assert 0 < met[0].count() < len(near) / 3
            assert met[0].groupBy("release_id").count().where("count > 9 * 2 * 2 * 9").isEmpty()


@pytest.mark.parametrize("name", ["band_match", "band_ranges"])
def test_listed_pairs_follow_one_another(spark, monkeypatch, thrice, name):
    """All pairs are a result of many rows over few ids: an upload's pairs in a bucket come together, in partitions of few uploads."""
    monkeypatch.setattr(matching, "PART_ROWS", 20_000)
    got = plans.QUERIES[name](spark, thrice)
    parts = got.rdd.map(lambda r: r.url).glom().collect()
    assert len(parts) > 8
    runs = sum(a != b for part in parts for a, b in zip([None, *part], part))
    assert runs <= len({url for part in parts for url in part}) * (1 if name == "band_match" else 5)
    con = duckdb.connect()
    for table in SHIFT:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{thrice}/{table}.parquet'")
    assert got.count() == len(con.sql(plans.ORACLE_SQL[name]).fetchall())


def test_candidates_are_ranked_where_pairs_meet(spark, small):
    """Of a stem's candidates the first is kept while pairs are made; nothing is dealt out anew above the join."""
    lines = plans.QUERIES["ranked_candidates"](spark, small)._jdf.queryExecution().executedPlan().toString().split("\n")
    pairs = max(i for i, x in enumerate(lines) if "Join" in x and "_band" in x)
    assert any("partial_min(number" in x for x in lines[:pairs]) and not any("Exchange" in x for x in lines[:pairs])


def test_ranking_in_bands_is_the_ranking_of_all_pairs(spark):
    """One order of a bucket's candidates ranks those of each release, whatever is missing, alike or at odd hours."""
    import datetime as dt
    import random

    rng = random.Random(17)
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    left = [(i, day(rng.randrange(12)) if i % 17 else None, float(low := rng.randrange(1, 60)) if (i + 1) % 19 else None, float(low + rng.choice([0, 2, 40, 700]))) for i in range(150)]
    left += [(200 + i, *left[i][1:]) for i in range(40)] + [(300, day(3), 5.0, float("inf"))]
    right = [(f"u{i}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(290)) if i % 23 else None, float(rng.randrange(60)) if i % 29 else None, rng.choice([0, 1, 2, 3, None]), rng.choice([None, 5, 7]), rng.choice(["a", "b", "c", "", None])) for i in range(300)]
    releases = spark.createDataFrame(left, "release_id long, released date, low double, high double")
    candidates = spark.createDataFrame(right, "url string, uploaded timestamp, duration double, tier int, views long, stem string")
    columns = ["release_id", "url", "tier", "place"]
    pairs = matching.band_join(releases, candidates).withColumn("lag", F.datediff("uploaded", "released").cast("long"))
    want = sorted(map(tuple, matching.ranked(pairs).select(columns).collect()))
    got = matching.ranked_in_bands(releases, candidates, "released", "low", "high")
    assert sorted(map(tuple, got.select(columns).collect())) == want
    assert len(want) > 300 and {x[-1] for x in want} == {1, 2, 3} and 300 in {x[0] for x in want}


def test_coded_candidates_are_sent_twice_at_most(spark, small):
    """By their code and by their release: neither parts nor tombstones send them anew, and titles stay behind."""
    plan = plans.QUERIES["exact_code_lane"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("\n") if "Exchange hashpartitioning" in x]) <= 4 and "Expand" not in plan
    assert not any("title" in x for x in plan.split("\n") if "FileScan" in x and "coded" in x)


def test_few_buckets_hold_a_candidate_twice(spark):
    """Where releases stay in one bucket, a candidate is entered only where a release can reach it."""
    left = spark.range(300).selectExpr("id AS release_id", "date_add(date'2026-01-01', int(id % 60)) AS released", "double(id * 7) AS low", "double(id * 7 + 2) AS high")
    right = spark.range(4000).selectExpr("id AS number", "timestamp(date_add(date'2026-01-01', int(id % 61))) AS uploaded", "double(id % 2100) AS duration")
    made = []
    got = matching.band_join(left, right, tol=5.0, together=True, dealt=lambda rows: made.append(rows.count()) or rows)
    assert made[0] < 2.5 * 4000
    want = matching.band_join(left, right, tol=5.0)
    assert sorted(map(tuple, got.select("release_id", "number").collect())) == sorted(map(tuple, want.select("release_id", "number").collect())) != []
