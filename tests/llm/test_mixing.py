from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from almanac.llm import mixing
from tests.llm.common import folder, none, odd


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return {**fixed, **target}
        fixed.update({s: most * sizes[s] for s in above})


def test_targets_and_taken(spark, small):
    rows = mixing.op2_mixing(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size
    want = water(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 3 * largest[s]


def test_sql_and_reruns(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE).select("doc_id, size, source_size, target, taken").fetchall())
    assert sorted(map(tuple, mixing.op2_mixing(spark, small).collect())) == want == sorted(map(tuple, mixing.op2_mixing(spark, small).collect()))


def test_odd_rows(spark, tmp_path):
    rows = mixing.mixed(odd(spark, extra=["_source", "_nth"]))
    assert rows.count() == 12 and rows.where("copies < 0 or copies > 3").count() == 0
    sizes = {(r.doc_id, r.size) for r in rows.collect()}
    assert (2, 0) in sizes and (3, 0) in sizes and (4, 0) in sizes and (6, 6) in sizes
    assert mixing.mixed(none(spark)).count() == 0 and mixing.repeated(none(spark)).count() == 0
    mixed = mixing.repeated(odd(spark))
    assert mixed.columns == odd(spark).columns
    assert mixed.count() == mixing.mixed(odd(spark)).agg(F.sum("copies")).first()[0]


def test_one_hot_source(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 30).cast("string"))).alias("source"))
    rows = mixing.mixed(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 4 for r in rows)
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_clashing_columns_are_kept(spark):
    extra = ["rate", "target", "source_size", "_start", "_nth", "_name", "size", "copies", "_copy", "_source", "_in0"]
    rows = mixing.repeated(odd(spark, extra=extra))
    assert rows.columns == [*odd(spark).columns, *extra] and rows.schema == odd(spark, extra=extra).schema
    found = rows.collect()
    assert found and all(r[c] == "kept" for r in found for c in extra)
    assert sorted(str(r[:5]) for r in found) == sorted(str(r[:5]) for r in mixing.repeated(odd(spark)).collect())
    added = mixing.mixed(odd(spark, extra=extra)).collect()
    assert len(added) == 12 and all(r[c] == "kept" for r in added for c in set(extra) - set(mixing.ADDED)) and all(r.size != "kept" for r in added)


def test_null_keys_are_spread(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    name = F.md5(F.concat_ws("/", F.lit(""), F.md5("text")))
    assert docs.groupBy(F.substring(name, 1, 2)).count().agg(F.max("count")).first()[0] < 60
    assert mixing.mixed(docs).agg(F.sum("copies")).first()[0] == 4000
