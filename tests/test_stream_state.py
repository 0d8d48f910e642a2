"""Slots and interval joins on streams of several files, against a replay in plain Python."""

import datetime as dt
import random

import pytest

from quarryspark.streaming import jobs, slots

T0 = dt.datetime(2024, 1, 31, 23, 50)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", slots.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream(spark, folder, batches, schema):
    """A stream that reads the batches one by one."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, frame, name, tmp_path):
    q = frame.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


SHAPE = "key string, request_id string, kind string, ts timestamp, chars long"


def replay(rows, x):
    """Slots by request; counters by their period's name."""
    out, state = [], {}
    for key, name, kind, ts, chars in sorted(rows, key=lambda r: (r[3], r[1])):
        taken, used = state.setdefault(key, ({}, {}))
        for other, since in sorted(taken.items(), key=lambda kv: (kv[1], kv[0])):
            if since + dt.timedelta(seconds=x.slot_seconds) <= ts:
                del taken[other]
                out.append((key, other, since + dt.timedelta(seconds=x.slot_seconds), "expired", None))
        if kind == "release":
            if taken.pop(name, None):
                out.append((key, name, ts, "released", None))
            continue
        tokens, n = x.tokens(chars or 0), max(1, chars or 0)
        spent = {("r", ts.strftime("%d%H%M")): (1, x.requests_a_minute, "requests"), ("c", ts.strftime("%d%H%M")): (n, x.chars_a_minute, "chars"), "slots": (None, None, "slots"), ("d", ts.date()): (tokens, x.day_tokens, "day_tokens"), ("m", ts.month): (tokens, x.month_tokens, "month_tokens")}
        reason = "repeated" if name in taken else None
        for k, (more, most, why) in spent.items():
            if reason is None and (len(taken) >= x.slots if k == "slots" else used.get(k, 0) + more > most):
                reason = why
        if reason is None:
            taken[name] = ts
            for k, (more, _, _) in spent.items():
                if k != "slots":
                    used[k] = used.get(k, 0) + more
        out.append((key, name, ts, "rejected" if reason else "admitted", reason))
    for key, (taken, _) in state.items():
        out += [(key, other, since + dt.timedelta(seconds=x.slot_seconds), "expired", None) for other, since in taken.items()]
    return out


def test_slots_equal_a_replay(rocks, tmp_path):
    r, rows, open_ = random.Random(4), [], []
    at = T0
    for k in range(220):
        at += dt.timedelta(seconds=r.choice([0, 1, 5, 5, 20, 40]))
        key = r.choice(["a", "a", "b"])
        if open_ and r.random() < 0.35:
            rows.append((*open_.pop(r.randrange(len(open_))), "release", at, None))
        else:
            name = f"r{k:03}" if r.random() < 0.95 else f"r{k - 3:03}"
            rows.append((key, name, "acquire", at, r.choice([None, 10, 400, 900])))
            open_.append((key, name))
    limits = slots.Limits(requests_a_minute=2, chars_a_minute=1500, slots=3, day_tokens=9000, month_tokens=16_000, slot_seconds=100)
    batches = [rows[:60], rows[60:61], rows[61:150], rows[150:], [("z", "end", "acquire", at + dt.timedelta(hours=1), 1)]]
    got = drained(rocks, slots.budget_with_slots(stream(rocks, tmp_path / "in", batches, SHAPE), limits), "slots", tmp_path)
    found = sorted((x.key, x.request_id, x.ts, x.outcome, x.reason or "") for x in got if x.key != "z")
    wanted = sorted((*x[:4], x[4] or "") for x in replay(rows, limits))
    assert found == wanted
    assert {x[3] for x in found} == {"admitted", "rejected", "released", "expired"}
    assert {x[4] for x in found} >= {"requests", "chars", "slots", "day_tokens"}
    assert all(0 <= x.in_flight <= 3 for x in got)


def test_a_slot_ends_by_its_timer(rocks, tmp_path):
    """No later row of the key: the watermark, moved on by another key, ends the slot."""
    limits = slots.Limits(10, 10_000, 1, 100_000, 100_000, slot_seconds=60)
    batches = [[("a", "one", "acquire", T0, 5)], [("b", "two", "acquire", T0 + dt.timedelta(minutes=30), 5)], [("a", "three", "acquire", T0 + dt.timedelta(minutes=31), 5)]]
    got = drained(rocks, slots.budget_with_slots(stream(rocks, tmp_path / "in", batches, SHAPE), limits), "timer", tmp_path)
    assert [x.ts for x in got if (x.request_id, x.outcome) == ("one", "expired")] == [T0 + dt.timedelta(seconds=60)]
    assert [x.outcome for x in got if x.request_id == "three"] == ["admitted"]


def test_stages_that_never_end(spark, tmp_path):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    started = [[("j1", "understanding", m(0)), ("j2", "understanding", m(1)), ("j3", "indexing", m(2)), ("j4", "discovery", m(2))], [("j1", "discovery", m(20)), ("zz", "discovery", m(200))], [("zz", "discovery", m(400))]]
    ended = [[("j1", "understanding", m(10), "completed"), ("j3", "indexing", m(3), "completed")], [("j4", "discovery", m(9), "failed"), ("j2", "understanding", m(40), "completed"), ("zz", "x", m(200), "completed")], [("zz", "x", m(400), "completed")]]
    a = stream(spark, tmp_path / "a", started, "job_id string, stage string, started_at timestamp")
    b = stream(spark, tmp_path / "b", ended, "job_id string, stage string, ended_at timestamp, status string")
    got = drained(spark, jobs.stage_ends(a, b, "30 minutes", "15 minutes"), "stages", tmp_path)
    found = {(x.job_id, x.stage): (x.state, x.ended_at, x.next_stage) for x in got if x.job_id != "zz"}
    assert found == {
        ("j1", "understanding"): ("completed", m(10), "discovery"),
        ("j1", "discovery"): ("timed_out", None, None),
        ("j2", "understanding"): ("timed_out", None, None),  # it ended after 39 minutes
        ("j3", "indexing"): ("completed", m(3), None),
        ("j4", "discovery"): ("failed", m(9), None),  # its end came in a later file, within the allowed lateness
    }


def test_missing_and_late_heartbeats(spark, tmp_path):
    s = lambda k: T0 + dt.timedelta(seconds=k)
    locked = [[("beats", s(0)), ("silent", s(0)), ("slow", s(5))], [("zz", s(5000))], [("zz", s(9000))], [("zz", s(9100))], [("zz", s(9200))]]
    beats = [[("beats", s(10)), ("beats", s(50)), ("slow", s(200)), ("silent", s(0))], [("zz", s(5000))], [("zz", s(9000))], [("zz", s(9100))], [("beats", s(40)), ("zz", s(9200))]]
    a = stream(spark, tmp_path / "a", locked, "job_id string, locked_at timestamp")
    b = stream(spark, tmp_path / "b", beats, "job_id string, beat_at timestamp")
    got = drained(spark, jobs.leases(a, b, "60 seconds"), "leases", tmp_path)
    found = sorted((x.job_id, x.action, x.beat_at or T0) for x in got if x.job_id != "zz")
    assert found == [("beats", "keep", s(10)), ("beats", "keep", s(50)), ("silent", "recover", T0), ("slow", "recover", T0)]  # the beat of an hour ago is dropped
