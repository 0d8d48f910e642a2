import datetime as dt

import pytest

from quarryspark.streaming import limits, outbox

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Ten-second steps of two users, in two files."""
    rows = [(k, f"u{k % 2}", T0 + dt.timedelta(seconds=10 * k), f"n{k % 7}") for k in range(20)]
    frame = spark.createDataFrame(rows, "event_id long, user string, ts timestamp, nonce string")
    frame.where("event_id < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    frame.where("event_id >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return outbox.source(spark, str(tmp_path / "in"), frame.schema), frame


def drained(spark, frame, name, mode="append"):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_sliding_limit_forgets_rejected(spark, stream):
    got = drained(spark, limits.sliding_limit(stream[0], "user", "event_id", "ts", 60, 2), "slid")
    allowed = sorted(r.event_id for r in got if r.allowed)
    assert allowed == [0, 1, 2, 3, 6, 7, 8, 9, 12, 13, 14, 15, 18, 19]


def test_pacing_and_budget(spark, stream):
    paced = drained(spark, limits.paced(stream[0], "user", "event_id", "ts", 50), "paced")
    assert sorted(r.event_id for r in paced if r.allowed and r.key == "u0") == [0, 6, 12, 18]
    spent = drained(spark, limits.budget(stream[0], "user", "event_id", "ts", 5, 3), "spent")
    assert sorted(r.event_id for r in spent if r.allowed and r.key == "u0") == [0, 2, 4]


def test_replay(spark, stream):
    got = drained(spark, limits.once(stream[0], "nonce", "ts", "1 hour"), "replay")
    assert sorted(r.nonce for r in got) == [f"n{k}" for k in range(7)]


def test_windows_match_batch(spark, stream):
    got = drained(spark, limits.tumbling(stream[0], "user", "ts", "1 minute", "1 minute"), "tumbled", "complete")
    from pyspark.sql import functions as F

    wanted = stream[1].groupBy(F.window("ts", "1 minute").start.alias("start"), "user").count().collect()
    assert {(r.start, r.user, r.n) for r in got} == {(r.start, r.user, r["count"]) for r in wanted}


def test_queue(spark, stream, tmp_path):
    seen = []
    outbox.drain(stream[0], lambda frame, k: seen.append(sorted(r.event_id for r in frame.collect())), str(tmp_path / "check")).awaitTermination()
    assert seen == [list(range(10)), list(range(10, 20))]
    outbox.drain(stream[0], lambda frame, k: seen.append("again"), str(tmp_path / "check")).awaitTermination()
    assert len(seen) == 2


def test_retries_and_publish(spark):
    events = spark.createDataFrame([(1, "pending", 0), (2, "retry", 4), (3, "pending", 0), (4, "pending", 0)], "event_id long, status string, attempts int")
    outcomes = spark.createDataFrame([(1, True, T0), (2, False, T0), (3, False, T0)], "event_id long, ok boolean, at timestamp")
    got = {r.event_id: (r.status, r.attempts, r.next_retry_at) for r in outbox.after_attempts(events, outcomes).collect()}
    assert got[1][0] == "done" and got[2][0] == "dead_letter" and got[4][0] == "pending"
    assert got[3] == ("retry", 1, T0 + dt.timedelta(seconds=30))
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "event_id long, idempotency_key string")
    stored = spark.createDataFrame([("b",)], "idempotency_key string")
    assert sorted(r.event_id for r in outbox.publish(new, stored).collect()) == [1, 3, 4]


def test_sessions_and_late_rows(spark, tmp_path):
    """A gap ends a session; a row behind the watermark is dropped, one within it joins its session."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user string, ts timestamp"
    at = lambda *s: [("a", T0 + dt.timedelta(seconds=x)) for x in s]
    (tmp_path / "in").mkdir()
    stream = outbox.source(spark, folder, spark.createDataFrame([], schema).schema)
    for rows in (at(0, 20, 200), at(210, 500), at(30, 505), at(2000)):  # 30 comes after the watermark has passed it
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        sessions = limits.sessions(stream, "user", "ts", "1 minute", "1 minute")
        sessions.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(((r.start - T0).seconds, (r.end - T0).seconds, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(0, 80, 2), (200, 270, 2), (500, 565, 2)]


def test_poll_goes_on(spark, stream, tmp_path):
    import time

    seen = []
    running = outbox.poll(stream[0], lambda batch, k: seen.extend(r.event_id for r in batch.collect()), str(tmp_path / "c"), "100 milliseconds")
    try:
        until = time.time() + 40
        while len(seen) < 20 and time.time() < until:
            time.sleep(0.2)
    finally:
        running.stop()
    assert sorted(seen) == list(range(20))


def test_idle_state_is_dropped(spark, tmp_path):
    """A key that has been quiet for longer than the limit looks back has no state left."""
    for k, rows in enumerate([[(0, "a", T0)], [(1, "b", T0 + dt.timedelta(hours=1))], [(2, "b", T0 + dt.timedelta(hours=2))], [(3, "a", T0 + dt.timedelta(hours=2))]]):
        spark.createDataFrame(rows, "event_id long, user string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = outbox.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = limits.sliding_limit(frame, "user", "event_id", "ts", 60, 1).writeStream.format("memory").queryName("idle").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("idle").collect() if r.allowed) == [0, 1, 2, 3]
    removed = sum(s["numRowsRemoved"] for p in q.recentProgress for s in p["stateOperators"])
    assert removed >= 1
