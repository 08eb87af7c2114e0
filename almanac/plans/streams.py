"""Streaming queries: the given tables as streams, one cycle over all that there is, and what the cycle leaves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators.staging import scratch_path
from almanac.operators.upsert import VersionedTable
from almanac.plans.registry import ORACLE_SQL, query, tables
from almanac.streaming import cycle

C = F.col
#: Second of the first check: a time of zero would be as late as the first watermark.
EPOCH = 1_700_000_000


def streamed(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream: its folder, or the one file of that name."""
    (rows,) = tables(spark, sf_dir, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(rows.schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(path.toString())
    return reader.option("pathGlobFilter", path.getName()).parquet(sf_dir)


def ended(stream: DataFrame, mode: str = "append", settings: dict[str, str] | None = None, apply: Callable | None = None) -> DataFrame | None:
    """Runs a cycle over a stream; what its last batches wrote, a folder a batch, or what ``apply`` made of them."""
    spark = stream.sparkSession
    out = scratch_path(spark, "cycle")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    before = {name: spark.conf.get(name, None) for name in settings or {}}
    for name, value in (settings or {}).items():
        spark.conf.set(name, value)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(apply or keep).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return None if apply else spark.read.parquet(f"{out}/rows")


def whole(stream: DataFrame) -> DataFrame:
    """All windows of a stream after its last batch, which has them all in this mode."""
    rows = ended(stream, "complete")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


@query(ORACLE_SQL["strike_machine"])
def stream_strikes(spark, sf_dir):
    """Events as checks of links: the state that a stream with timers leaves, the same as that of the batch fold."""
    outcome = F.when(C("event_type") == "error", "dead").when(C("event_type") == "view", "live").otherwise("inconclusive")
    checks = streamed(spark, sf_dir, "events").select(C("user_id").alias("link"), F.timestamp_seconds(C("event_id") + EPOCH).alias("at"), outcome.alias("outcome"))
    rows = ended(cycle.strike_states(checks), "update", cycle.STORE).where("due_at is null")
    last = F.max(F.struct("batch", "strikes", "dead", "dead_at")).alias("r")
    return rows.groupBy("link").agg(last).select("link", "r.strikes", "r.dead", (F.unix_seconds("r.dead_at") - EPOCH).alias("dead_at"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Events by day and type, counted in event-time windows."""
    rows = whole(cycle.windowed_counts(streamed(spark, sf_dir, "events").withColumn("at", C("ts").cast("timestamp")), "at", "event_type"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), C("event_type").alias("kind"), "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM n GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    """Sessions of users: events with less than six hours between them."""
    rows = whole(cycle.session_counts(streamed(spark, sf_dir, "events").withColumn("at", C("ts").cast("timestamp")), "at", "user_id", "6 hours"))
    return rows.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_records(spark, sf_dir):
    """Each user once, whichever event comes first within the watermark."""
    return ended(cycle.first_records(streamed(spark, sf_dir, "events").withColumn("at", C("ts").cast("timestamp")), "user_id", "at", "4000 days")).select("user_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")
def stream_retention(spark, sf_dir):
    """All orders as they come, of which a store keeps the year before the newest."""
    table = VersionedTable(spark, scratch_path(spark, "kept"))
    ended(streamed(spark, sf_dir, "orders"), apply=cycle.retention(table, ["o_orderkey"], "o_orderdate", 365))
    return table.read().select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 < 4 THEN 'new' ELSE 'old' END AS state FROM part")
def stream_snapshot(spark, sf_dir):
    """Two listings that arrive one after the other, laid over each other as far as the second one is new."""
    (part,) = tables(spark, sf_dir, "part")
    table, source = VersionedTable(spark, scratch_path(spark, "snapshot")), scratch_path(spark, "listings")
    rows = part.select(C("p_partkey").alias("id"), (C("p_partkey") % 10).alias("page"))
    for state, listing in (("old", rows.where("page >= 4")), ("new", rows.where("page < 6"))):
        listing.withColumn("state", F.lit(state)).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, page long, state string").parquet(source)
        cycle.run_cycle(stream, f"{source}-checkpoint", cycle.snapshots(table, "page", "id")).awaitTermination()
    return table.read().select("id", "state")
