"""Budgets with in-flight slots, as one stateful operator: limits a minute, a day and a month, and slots that are released or expire."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, request_id string, at long, outcome string, reason string, in_flight int"
_COUNTERS = "minute long, requests long, chars long, day long, day_tokens long, month long, month_tokens long, seen long"


@dataclass(frozen=True)
class Limits:
    """What one key may use. A slot that isn't released is free again after ``slot_seconds``; the state of a key without a request for
    ``idle_seconds`` is dropped (no counter reaches beyond a month)."""

    requests_a_minute: int
    chars_a_minute: int
    slots: int
    day_tokens: int
    month_tokens: int
    completion_tokens: int = 300
    slot_seconds: int = 180
    idle_seconds: int = 40 * 24 * 3600

    def tokens(self, chars: int) -> int:
        return max(1, max(1, round(max(1, chars) / 4)) + self.completion_tokens)


class Budget(StatefulProcessor):
    """Requests of a key in the order of (ts, request_id) of each batch. A rejected request changes no counter."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.slots = handle.getMapState("slots", "request_id string", "since long")

    def close(self) -> None:
        pass

    def _expired(self, key: str, now: int) -> list[tuple]:
        """Slots that have outlived their time at ``now`` (milliseconds) go."""
        ended = sorted((since + self.limits.slot_seconds * 1000, name) for (name,), (since,) in list(self.slots.iterator()) if since + self.limits.slot_seconds * 1000 <= now)
        for _, name in ended:
            self.slots.removeKey((name,))
        left = sum(1 for _ in self.slots.keys()) if ended else 0
        return [(key, name, at, "expired", None, left + len(ended) - 1 - n) for n, (at, name) in enumerate(ended)]

    def _rejection(self, n: dict[str, int], chars: int, tokens: int, taken: int) -> str | None:
        x = self.limits
        checks = (
            ("requests", n["requests"] + 1 > x.requests_a_minute),
            ("chars", n["chars"] + max(1, chars) > x.chars_a_minute),
            ("slots", taken + 1 > x.slots),
            ("day_tokens", n["day_tokens"] + tokens > x.day_tokens),
            ("month_tokens", n["month_tokens"] + tokens > x.month_tokens),
        )
        return next((name for name, failed in checks if failed), None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (name,), out = key, []
        for r in pd.concat(list(rows)).sort_values(["at", "request_id"]).itertuples(index=False):
            at = int(r.at)
            out += self._expired(name, at)
            held = self.counters.get() if self.counters.exists() else None
            n = dict(zip(("minute", "requests", "chars", "day", "day_tokens", "month", "month_tokens", "seen"), held, strict=True)) if held else dict.fromkeys(("minute", "requests", "chars", "day", "day_tokens", "month", "month_tokens", "seen"), 0)
            taken = sum(1 for _ in self.slots.keys())
            if r.kind == "release":
                if self.slots.containsKey((r.request_id,)):
                    self.slots.removeKey((r.request_id,))
                    out.append((name, r.request_id, at, "released", None, taken - 1))
                continue
            day = dt.datetime.fromtimestamp(at / 1000, dt.UTC)
            now = {"minute": at // 60_000, "day": at // 86_400_000, "month": day.year * 12 + day.month}
            for period, fields in (("minute", ("requests", "chars")), ("day", ("day_tokens",)), ("month", ("month_tokens",))):
                if n[period] != now[period]:
                    n |= {period: now[period]} | dict.fromkeys(fields, 0)
            chars = int(r.chars)
            tokens = self.limits.tokens(chars)
            reason = "repeated" if self.slots.containsKey((r.request_id,)) else self._rejection(n, chars, tokens, taken)
            if reason is None:
                for field, more in (("requests", 1), ("chars", max(1, chars)), ("day_tokens", tokens), ("month_tokens", tokens)):
                    n[field] += more
                self.slots.updateValue((r.request_id,), (at,))
                self.handle.registerTimer(at + self.limits.slot_seconds * 1000)
                taken += 1
            n["seen"] = max(n["seen"], at)
            self.counters.update(tuple(n.values()))
            self.handle.registerTimer(at + self.limits.idle_seconds * 1000)
            out.append((name, r.request_id, at, "rejected" if reason else "admitted", reason, taken))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = self._expired(key[0], at)
        if self.counters.exists() and self.counters.get()[7] + self.limits.idle_seconds * 1000 <= at:
            self.counters.clear()
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "request_id", "at", "outcome", "reason", "in_flight"])


def budget_with_slots(requests: DataFrame, limits: Limits, late: str = "1 minute") -> DataFrame:
    """(key, request_id, ts, outcome, reason, in_flight) of a stream of requests (key, request_id, kind: acquire or release, ts, chars): admitted,
    rejected with the limit that was reached, released, or expired. Slots end by event time: when a later row of the key shows it, or by a timer
    once the watermark has passed. Releases of slots that there aren't say nothing; a request whose slot is still taken is rejected as repeated.
    Needs the RocksDB state store (``STATE_STORE``)."""
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("request_id").cast("string").alias("request_id"), "kind", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("chars").cast("long"), F.lit(0)).alias("chars"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    out = rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Budget(limits), OUT, "Append", "EventTime")
    return out.select("key", "request_id", F.timestamp_millis("at").alias("ts"), "outcome", "reason", "in_flight")
