"""Streaming forms of the refresh cycle: strikes as keyed state, deduplication, retention."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from almanac.operators.dedupe import last_write
from almanac.operators.links import STRIKES
from almanac.operators.upsert import VersionedTable, expired, upserted
from almanac.sources.feeds import refreshed

#: Hours after which a live link is due for another check.
RECHECK = 24
STRIKE_STATE = "strikes int, dead_at timestamp, seen_at timestamp"
STRIKE_ROWS = "link long, strikes int, dead boolean, dead_at timestamp, due_at timestamp"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def struck(strikes: int, at: np.ndarray, dead: np.ndarray) -> tuple[int, np.datetime64 | None]:
    """(strikes, when the link died) after checks in order of time, of which ``dead`` says the outcome; None if it lives.

    Strikes before the first live check go on with those of the state; from there on a run of dead
    checks is as long as the distance to the last live one.
    """
    n = np.arange(1, len(dead) + 1)
    last_live = np.maximum.accumulate(np.where(dead, 0, n))
    run = n - last_live + np.where(last_live == 0, strikes, 0)
    out = np.flatnonzero(dead & (run >= STRIKES))
    return (STRIKES, at[out[0]]) if len(out) else (int(run[-1]) if len(run) else strikes, None)


class Strikes(StatefulProcessor):
    """The strikes of a link, and a timer for its next check: a row for each change, and one when it is due."""

    def __init__(self, hours: int = RECHECK):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("strikes", STRIKE_STATE)

    def row(self, key: tuple, due_at: datetime.datetime | None = None) -> pd.DataFrame:
        strikes, dead_at, _ = self.state.get()
        return pd.DataFrame({"link": [key[0]], "strikes": [strikes], "dead": [dead_at is not None], "dead_at": pd.to_datetime([dead_at]), "due_at": pd.to_datetime([due_at])})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        strikes, dead_at, seen_at = self.state.get() if self.state.exists() else (0, None, None)
        parts = [(x["at"].to_numpy("datetime64[us]"), (x["outcome"] == "dead").to_numpy(), (x["outcome"] == "live").to_numpy()) for x in rows]
        at, dead, live = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(at, kind="stable")
        at, dead, telling = at[order], dead[order], (dead | live)[order]
        if dead_at is None:
            strikes, died = struck(strikes, at[telling], dead[telling])
            dead_at = None if died is None else died.item()
        seen_at = max(at[-1].item(), seen_at or at[-1].item())
        self.state.update((strikes, dead_at, seen_at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if dead_at is None:
            due = seen_at + datetime.timedelta(hours=self.hours)
            self.handle.registerTimer(int(due.replace(tzinfo=datetime.UTC).timestamp() * 1000))
        yield self.row(key)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, datetime.UTC)
        yield self.row(key, due.replace(tzinfo=None))

    def close(self) -> None:
        pass


def strike_states(checks: DataFrame, *, late: str = "0 seconds", hours: int = RECHECK) -> DataFrame:
    """Link states after each batch of checks (link, at, outcome), and a row with ``due_at`` for each link that is due.

    The state is a few numbers a link.  A check that tells nothing adds no strike and takes none; those
    of a link within a batch are applied in order of time.  A link that lives is due ``hours`` after its
    last check, once the watermark has passed that; a dead one never.  Needs a session of UTC and the
    settings in STORE.
    """
    return checks.withWatermark("at", late).groupBy("link").transformWithStateInPandas(Strikes(hours), STRIKE_ROWS, "Update", "EventTime")


def first_records(records: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each record once; a repeat within the watermark is dropped."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(records: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by event-time window, one after the other or, with ``slide``, overlapping; an addition to
    the batch operators, which have no event time.  Records later than the watermark are dropped."""
    own = F.window(at, width, slide) if slide else F.window(at, width)
    return records.withWatermark(at, late).groupBy(own.alias("window"), by).agg(F.count(F.lit(1)).alias("n"))


def session_counts(records: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Counts by session: records of one key with no more than ``gap`` between them; an addition too."""
    return records.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("window"), by).agg(F.count(F.lit(1)).alias("n"))


def run_cycle(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """One cycle over all that has arrived: ``apply`` gets each batch with its number.

    A checkpoint has one running query at a time, so cycles never overlap; a batch that is repeated
    after a failure keeps its number.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def retention(table: VersionedTable, keys: list[str], date: str, days: int) -> Callable[[DataFrame, int], None]:
    """A batch function: rows of the batch replace those of their keys, and what is older than ``days``
    before the newest date goes.  Repeating a batch changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        old = table.read()
        new = last_write(batch, keys, date)
        rows = new if old is None else upserted(old, new, keys)
        newest = rows.agg(F.max(date)).first()[0]
        if newest is not None:
            table.write(expired(rows, date, F.lit(newest) - F.make_dt_interval(F.lit(days)))[0])

    return apply


def snapshots(table: VersionedTable, page: str, key: str, full: bool = False) -> Callable[[DataFrame, int], None]:
    """A batch function: each batch is one listing, laid over the snapshot before it (see feeds.refreshed)."""

    def apply(batch: DataFrame, _: int) -> None:
        old = table.read()
        table.write(refreshed(batch.drop(page).limit(0) if old is None else old, batch, page, key, full))

    return apply
