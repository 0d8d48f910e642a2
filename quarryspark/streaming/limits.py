"""Stateful stream operators: limiters, replay protection, pacing, budgets, windows.

Each has a batch twin in ``operators.ordered`` where the result doesn't depend on what was rejected before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, event_id long, ts timestamp, allowed boolean"


def _prepared(events: DataFrame, key: str, event_id: str, ts: str) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), F.col(event_id).alias("event_id"), F.col(ts).cast("timestamp").alias("ts"))


def _stateful(events: DataFrame, step, state: str, idle_seconds: float | None = None, late: str = "1 minute") -> DataFrame:
    """Runs ``step(rows in order, state tuple) -> (flags, state tuple)`` for each key and batch. With ``idle_seconds``, after which a key's
    state says nothing any more, it is dropped once the watermark has passed that; rows later than ``late`` are dropped then, too."""

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        flags, new = step(rows, held.get if held.exists else None)
        held.update(new)
        if idle_seconds is not None:
            last = int(rows["ts"].astype("datetime64[us]").astype("int64").max() // 1000)
            held.setTimeoutTimestamp(max(last + int(idle_seconds * 1000) + 1, held.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=flags)[["key", "event_id", "ts", "allowed"]]

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.EventTimeTimeout
    rows = events if idle_seconds is None else events.withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(run, _OUT, state, "append", timeout)


def sliding_limit(events: DataFrame, key: str, event_id: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """At most ``limit`` accepted events in any ``seconds``; rejected ones leave no trace."""

    def step(rows, held):
        log = list(held[0]) if held else []
        flags = []
        for t in rows["ts"].astype("int64") // 1000 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].astype("datetime64[us]").astype("int64"):
            log = [x for x in log if x > t - seconds * 1_000_000]
            flags.append(len(log) < limit)
            if flags[-1]:
                log.append(t)
        return flags, (log,)

    return _stateful(_prepared(events, key, event_id, ts), step, "log array<long>", seconds)


def paced(events: DataFrame, key: str, event_id: str, ts: str, seconds: float) -> DataFrame:
    """An event is accepted if the last accepted one is at least ``seconds`` ago."""

    def step(rows, held):
        last, flags = (held[0] if held else None), []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            flags.append(last is None or t - last >= seconds * 1_000_000)
            last = t if flags[-1] else last
        return flags, (last,)

    return _stateful(_prepared(events, key, event_id, ts), step, "last long", seconds)


def budget(events: DataFrame, key: str, event_id: str, ts: str, limit: int, day_limit: int) -> DataFrame:
    """Two counters at once, in total and for each day; an event that one of them rejects counts in neither. The total never ends, so its
    state stays; for budgets of a minute, a day and a month, with slots and timers, see ``slots``."""

    def step(rows, held):
        total, day, n = held if held else (0, -1, 0)
        flags = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            if t // 86_400_000_000 != day:
                day, n = int(t // 86_400_000_000), 0
            flags.append(total < limit and n < day_limit)
            total, n = total + flags[-1], n + flags[-1]
        return flags, (int(total), int(day), int(n))

    return _stateful(_prepared(events, key, event_id, ts), step, "total long, day long, n long")


def once(events: DataFrame, nonce: str, ts: str, ttl: str) -> DataFrame:
    """Replay protection: the first event of each nonce within the time to live."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark([nonce])


def tumbling(events: DataFrame, key: str, ts: str, width: str, late: str) -> DataFrame:
    """Counts for each key and window; events later than ``late`` are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after a gap, with their number of events."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
