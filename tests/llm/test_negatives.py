import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_version(rows, anchors, positives=5, most=10):
    """Hard negatives by scoring every row against every anchor."""
    points = {}
    for key, vector, label in rows:
        if key is not None and vector is not None and label is not None and all(x is not None and math.isfinite(x) for x in vector):
            points[key] = min(points.get(key, (label, vector)), (label, vector))
    points = {k: (label, [math.floor(256 * x) for x in v]) for k, (label, v) in points.items()}
    out = []
    for a, (label, v) in points.items():
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, m == label) for k, (m, w) in points.items() if k != a)
        for p, pid, _ in [x for x in scored if x[2]][:positives]:
            fit = [(s, k) for s, k, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:most]
            out += [(a, pid, r, k, -p, -s) for r, (s, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "signs", "zeros", "nothing"])
def test_equals_plain_version(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", 300 * 6)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    rng = np.random.default_rng(11)
    n = 0 if kind == "nothing" else 700
    vectors = {"ties": rng.integers(-2, 3, (n, 6)) / 4, "copies": np.repeat(rng.normal(size=(max(1, n // 350), 6)), 350, axis=0)[:n], "signs": np.abs(rng.normal(size=(n, 6))) * rng.choice([-1, 1], 6), "zeros": rng.integers(0, 2, (n, 6)) * (rng.random((n, 1)) < 0.3)}.get(kind, rng.normal(size=(n, 6)))
    vectors = vectors.astype(np.float32)
    rows = [(i, vectors[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [] if kind == "nothing" else [(None, [1.0] * 6, 1), (20, None, 1), (701, [1.0, None], 1), (702, [float("nan")] * 6, 1), (703, [float("inf")] * 6, 1), (704, [1.0] * 6, None), (710, [2.0], 2), (720, [], 0), *[(i, vectors[i].tolist(), 2) for i in range(0, 60, 3)]]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("id", F.lit("own")).withColumn("shard", F.lit(0))
    got = sorted(tuple(r) for r in negatives.mined(frame, F.col("id") % 20 == 0).collect())
    assert got == plain_version(rows, lambda k: k % 20 == 0)
    assert bool(got) == (kind != "nothing")


def test_reading_stops_early():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-100, 101, (20_000, 3))
    shard = negatives.Shard(np.arange(20_000), np.zeros(20_000, np.int64), vectors)
    anchor = np.array([5, -3, 0])
    ((ids, scores),) = shard.best(anchor, np.ones(20_000, bool), [(negatives.LOWEST, negatives.HIGHEST)], 5)
    every = vectors @ anchor
    assert list(zip((-scores).tolist(), ids.tolist())) == sorted(zip((-every).tolist(), range(20_000)))[:5]
    assert shard.read < 4_000


def test_wide_components(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [-1e30, 1.0], 1), (2, [1.0, 1.0], 2)]
    assert negatives.mined(spark.createDataFrame(rows, SCHEMA), F.col("id") == 2).count() == 0


def test_query_equals_sql(spark, small):
    for where in (small, small.replace("sf0.001", "sf0.01")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
        want, got = con.sql(negatives.ORACLE), negatives.op12_negatives(spark, where)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
