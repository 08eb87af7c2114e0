import numpy as np
import pytest

from almanac.llm import neargraph


def brute(rows, threshold=0.95):
    ids, vectors = [], []
    for k, v in rows:
        if k is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ids.append(k)
            vectors.append(np.array(v, dtype=float) / np.linalg.norm(v))
    hit = {(i, j) for i in range(len(ids)) for j in range(len(ids)) if i != j and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= threshold}
    low = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i, j in hit:
            if ids[low[j]] < ids[low[i]]:
                low[i], changed = low[j], True
    out = [(ids[i], sum(a == i for a, _ in hit), ids[low[i]]) for i in range(len(ids))]
    rest = [(k, 0, k) for k, v in rows if k is None or not v or None in v or not np.isfinite(v).all() or not any(v)]
    return sorted(out + rest, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def check(spark, rows):
    exact = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neargraph.near_duplicates(table(spark, rows)).collect()), key=repr)
    assert got == brute(exact)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0]), (11, [0.0, 1.0, 0.0]), (12, [-1.0, 0.0]), (None, [1.0, 0.0]), (13, [1e-30, 1e-38])]
    check(spark, rows)


def test_empty_table(spark):
    assert neargraph.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [60, 2400])
def test_many_shards_and_dense_clusters(spark, monkeypatch, limit):
    """With a small limit clusters split and a dense group is dealt into pairs of blocks."""
    monkeypatch.setattr(neargraph, "LIMIT", limit)
    monkeypatch.setattr(neargraph, "TARGET", limit // 2)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    vectors = [*rng.normal(size=(120, 16)), *(centre[rng.integers(12, size=120)] + 0.05 * rng.normal(size=(120, 16))), *(centre[0] + 0.02 * rng.normal(size=(130, 16)))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    want = {k: (n, c) for k, n, c in brute(rows)}
    found = neargraph.near_duplicates(table(spark, rows)).collect()
    true, got = sum(n for n, _ in want.values()), sum(r.n_links for r in found)
    assert all(r.n_links <= want[r.vec_id][0] for r in found)
    assert got >= 0.97 * true and sum(r.component_id == want[r.vec_id][1] for r in found) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 1500").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neargraph.near_duplicates(table(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def counted(rows, threshold=0.95):
    """Links of each row, all distinct and of one length."""
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return {k: int(n) - 1 for (k, _), n in zip(rows, (x @ x.T >= threshold).sum(axis=1))}


@pytest.mark.parametrize("noise", [0.03, 0.04])
def test_a_tight_ball_is_not_cut_up(spark, monkeypatch, noise):
    """Distinct vectors that are nearly all links of each other, enough for 40 centres."""
    monkeypatch.setattr(neargraph, "LIMIT", 60)
    monkeypatch.setattr(neargraph, "TARGET", 20)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=32)
    vectors = [*(centre / np.linalg.norm(centre) + noise * rng.normal(size=(500, 32))), *rng.normal(size=(300, 32))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    want = counted(rows)
    assert sum(want.values()) > 100_000
    found = {r.vec_id: r.n_links for r in neargraph.near_duplicates(table(spark, rows)).collect()}
    assert all(found[k] <= n for k, n in want.items()) and sum(found.values()) >= neargraph.RECALL * sum(want.values())


def test_too_low_a_recall_ends_in_all_pairs(spark, monkeypatch):
    for name, value in (("LIMIT", 60), ("TARGET", 20), ("OVERLAP", 6), ("RECALL", 1.1)):
        monkeypatch.setattr(neargraph, name, value)
    asked = []
    whole = neargraph.exact_links
    monkeypatch.setattr(neargraph, "exact_links", lambda *a, **k: asked.append(1) or whole(*a, **k))
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(4, 16))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(centre[rng.integers(4, size=200)] + 0.2 * rng.normal(size=(200, 16)))]
    check(spark, rows)
    assert asked


def units_of(spark, vectors):
    v = np.array(vectors, dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tobytes(), 1) for i, x in enumerate(v)], "id long, unit binary, n long")


def test_a_core_is_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(neargraph, "LIMIT", 50)
    rng = np.random.default_rng(1)
    vectors = units_of(spark, np.ones(16) + 0.01 * rng.normal(size=(200, 16)))
    routes = vectors.selectExpr("id", "unit", "n", "'c' as cluster", "200L as size")
    members = neargraph.cored(routes)
    assert members.where("core = 'c'").count() == 200 and neargraph.sharded(members).count() == 0
    assert {(r.links, r.root) for r in neargraph.core_links(vectors, members).collect()} == {(199, 0)}


def test_edges_that_leave_a_cluster_are_followed(spark):
    """1 and 3 share no cluster; 2 is in both, so 3 visits where 1 is, and the link is counted once."""
    x = np.array([[np.cos(t), np.sin(t)] for t in (0.0, 0.15, 0.3)])
    vectors = units_of(spark, x)
    lists = spark.createDataFrame([(0, [1], [1]), (1, [0, 2], [0, 2]), (2, [1], [1])], "id long, near array<long>, close array<long>")
    homes = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["b"])], "id long, homes array<string>").join(vectors, "id").selectExpr("*", "cast(null as string) core")
    guests = {(r.id, r.cluster) for r in neargraph.visitors(lists, homes).collect()}
    assert guests == {(0, "b"), (2, "a")}
    stands = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "b"]), (2, ["b", "a"])], "id long, clusters array<string>")
    rows = neargraph.sharded(homes.join(stands, "id").join(lists, "id").selectExpr("*", "explode(clusters) cluster"))
    found = rows.groupBy("shard").applyInArrow(lambda t: neargraph.linked(t, 0.95), "id long, links long, root long")
    assert {r.id: r.n for r in found.groupBy("id").agg({"links": "sum"}).toDF("id", "n").collect()} == {0: 2, 1: 2, 2: 2}


def test_nothing_to_measure_is_no_recall(spark):
    rng = np.random.default_rng(2)
    vectors = units_of(spark, rng.normal(size=(300, 32)))
    none = spark.createDataFrame([], "id long, links long")
    assert neargraph.audited(vectors, none) is None
    pairs = np.repeat(rng.normal(size=(30, 32)), 2, axis=0) + 1e-3 * rng.normal(size=(60, 32))
    vectors = units_of(spark, np.concatenate((rng.normal(size=(2000, 32)), pairs)))
    assert neargraph.audited(vectors, none, queries=20) == 0.0


def test_one_level_of_clusters_where_it_can_be(spark, monkeypatch):
    """Each level doubles the vectors' places, so clusters are as many as the places need, not more levels."""
    monkeypatch.setattr(neargraph, "LIMIT", 60)
    monkeypatch.setattr(neargraph, "TARGET", 20)
    vectors = units_of(spark, np.random.default_rng(4).normal(size=(2500, 8)))
    levels = neargraph.routed(vectors, 2).selectExpr("size(split(cluster, '[.]')) - 1 level").groupBy("level").count().collect()
    assert sum(r["count"] for r in levels if r.level == 1) > 0.8 * 2 * 2500


def test_a_long_list_makes_no_search_longer(monkeypatch):
    """Neighbours are looked at by the lists that are opened; one row that many name costs the others nothing."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[400:800] = x[400] + 0.01 * x[400:800]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = [np.unique([0, *(k for k in (i - 7, i - 1, i + 1, i + 7) if 0 < k < 900)]) if i else np.arange(1, 900) for i in range(900)]
    looked, einsum = [], np.einsum
    monkeypatch.setattr(neargraph.np, "einsum", lambda spec, a, b: looked.append(np.prod(b.shape[:-1])) or einsum(spec, a, b))
    got = neargraph.searched(x, lists, 0.95)
    assert (got[400:800, 400:800].sum(axis=1) == 399).all()
    assert sum(looked) <= 900 * 900  # no pair twice
