"""Link life-cycle: two strikes, tombstones, re-queueing, in one batch fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIKES = 2
#: Fixed value: why a link is dead that nobody gave a reason for.
LOST = "Link not found"


def folded(checks: DataFrame, *, key: str = "link", at: list[str] = ["at"], outcome: str = "outcome") -> DataFrame:
    """The state of each link after all its checks: strikes, dead, dead_at (ordinal values of ``at[0]``).

    live resets, dead adds a strike and the second one in a row buries the link for good,
    inconclusive changes nothing.  Written as a window over the checks that decide, so a link with
    very many checks is sorted and streamed, never gathered.
    """
    telling = checks.where(F.col(outcome).isin("live", "dead"))
    order = Window.partitionBy(key).orderBy(*at)
    rows = telling.withColumn("_again", (F.col(outcome) == "dead") & (F.lag(outcome).over(order) == "dead"))
    last = F.struct(*at)
    done = rows.groupBy(key).agg(F.min(F.when(F.col("_again"), F.col(at[0]))).alias("dead_at"), F.max_by(outcome, last).alias("last"))
    every = checks.select(key).distinct().join(done, key, "left")
    strikes = F.when(F.col("dead_at").isNotNull(), STRIKES).when(F.col("last") == "dead", 1).otherwise(0)
    return every.select(key, strikes.alias("strikes"), F.col("dead_at").isNotNull().alias("dead"), "dead_at")


def struck(links: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Links after one round of checks; links that were not checked stay as they are.

    ``links``: release_id, url, verify_failures, verified_at, dead_at, dead_reason; ``outcomes``:
    release_id, url, outcome and, where known, reason.  A live link alone is verified now: one with a
    strike stays as stale as it was, so it is checked again first.  The second strike buries it.
    """
    known = {"dead_reason": links, "reason": outcomes}
    for name, rows in known.items():
        known[name] = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
    out = known["dead_reason"].join(known["reason"].select("release_id", "url", "outcome", "reason"), ["release_id", "url"], "left")
    live, dead = F.col("outcome") == "live", F.col("outcome") == "dead"
    failures = F.when(live, 0).when(dead, F.col("verify_failures") + 1).otherwise(F.col("verify_failures"))
    buried, old = dead & (failures >= STRIKES), F.col("dead_at").isNotNull()
    return out.select(
        "release_id",
        "url",
        failures.cast("int").alias("verify_failures"),
        F.when(live, now).otherwise(F.col("verified_at")).alias("verified_at"),
        F.when(old, F.col("dead_at")).when(buried, now).alias("dead_at"),
        F.when(old, F.col("dead_reason")).when(buried, F.coalesce("reason", F.lit(LOST))).alias("dead_reason"),
    )


def requeued(releases: DataFrame, links: DataFrame) -> DataFrame:
    """Releases whose last live link is gone lose ``checked_at``, so that they are matched again."""
    left = links.groupBy("release_id").agg(F.count_if(F.col("dead_at").isNull()).alias("live"))
    out = releases.join(left, "release_id", "left")
    return out.withColumn("checked_at", F.when(F.col("live") == 0, F.lit(None)).otherwise(F.col("checked_at"))).drop("live")
