"""Block-wise vector search, and first rows of hot groups, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarryspark.operators import aggregates as A
from quarryspark.operators import control as O
from quarryspark.operators import vectorsearch as V

SHAPE = "vec_id long, label string, v array<double>"


def _points(n, seed):
    """Many equal vectors (ties), some that take no part."""
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "a", "a", "b", None]), [1.0, 2.0, 2.0] if k % 3 == 0 else [float(r.randrange(-3, 4)) for _ in range(3)]) for k in range(n)]
    return rows + [(n, "a", None), (n + 1, "a", [0.0, 0.0, 0.0]), (n + 2, "a", [1.0, None, 2.0]), (n + 3, "a", [float("nan"), 1.0, 1.0]), (n + 4, "a", [float("inf"), 1.0, 1.0]), (n + 5, "b", [1.0, 1.0]), (n + 6, "b", [1.0, 2.0]), (n + 7, "b", [])]


def _sound(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def _cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def brute(points, queries, k, by):
    out = set()
    for q, ql, qv in queries:
        if not _sound(qv):
            continue
        near = [(-round(_cosine(v, qv), 6), p) for p, pl, v in points if p != q and _sound(v) and len(v) == len(qv) and (not by or pl is not None and pl == ql)]
        out |= {(q, n + 1, p, -s) for n, (s, p) in enumerate(sorted(near)[:k])}
    return {(q, n, p, round(s, 5)) for q, n, p, s in out}


@pytest.mark.parametrize("by", [[], ["label"]])
@pytest.mark.parametrize("most_bytes", [V.BROADCAST_BYTES, 0])
def test_top_k(spark, monkeypatch, by, most_bytes):
    monkeypatch.setattr(V, "POINT_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 15)
    monkeypatch.setattr(V, "AT_ONCE", 7)
    rows = _points(200, 5)
    points = spark.createDataFrame(rows, SHAPE).repartition(3)
    asked = [r for r in rows if r[0] % 4 == 0 or r[0] >= 200]
    queries = spark.createDataFrame(asked, SHAPE).withColumnsRenamed({"vec_id": "query_id", "v": "q"})
    found = V.top_k(points, queries, 6, by, most_bytes=most_bytes).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 5)) for r in found} == brute(rows, asked, 6, by)


def test_only_unanswered_queries_are_searched_again(spark):
    rows = _points(60, 6)
    asked = [(r[0], "none" if r[0] % 8 == 0 else r[1], r[2]) for r in rows if r[0] % 4 == 0]
    queries = spark.createDataFrame(asked, SHAPE).withColumnsRenamed({"vec_id": "query_id", "v": "q"})
    found = {(r.query_id, r["rank"], r.vec_id, round(r.score, 5)) for r in V.soft_top_k(spark.createDataFrame(rows, SHAPE), queries, 3, ["label"]).collect()}
    strict = brute(rows, asked, 3, ["label"])
    empty = [q for q in asked if q[0] not in {x[0] for x in strict}]
    assert empty and found == strict | brute(rows, empty, 3, [])


def test_no_vectors(spark):
    none = spark.createDataFrame([], SHAPE)
    queries = none.withColumnsRenamed({"vec_id": "query_id", "v": "q"})
    some = spark.createDataFrame(_points(9, 1), SHAPE)
    assert V.top_k(none, queries, 3).count() == V.top_k(some, queries, 3).count() == V.top_k(none, some.withColumnsRenamed({"vec_id": "query_id", "v": "q"}), 3, most_bytes=0).count() == 0


def test_no_row_for_a_pair(spark):
    """The plan has neither a join nor a row for each pair: what is ranked is what the blocks have kept."""
    points = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("v"))
    queries = points.where("vec_id % 200 = 0").withColumnsRenamed({"vec_id": "query_id", "v": "q"})
    near = V.top_k(points, queries, 5)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert near.count() == 500


def test_first_of_hot_groups(spark):
    rows = [(None if k % 3 else "hot", k * 7919 % 1009, k) for k in range(900)]
    frame = spark.createDataFrame(rows, "g string, x long, id long")
    found = {(r.g, r.x, r.id) for r in A.first_of_group(frame, ["g"], [F.col("x"), F.col("id")], "id", 20, salts=5).collect()}
    wanted = {r for g in (None, "hot") for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])[:20]}
    assert found == wanted


def test_metrics_of_a_null_series(spark):
    rows = [(g, float(v), t, t) for g in (None, "a") for t, v in enumerate(range(50, 0, -1))]
    found = A.metric_series(spark.createDataFrame(rows, "g string, v double, ts long, id long"), ["g"], "v", "ts", "id", window=11).collect()
    assert {(r.g, r.n, r.total, r.least, r.most, r["last"], r.p50) for r in found} == {(g, 50, 1275.0, 1.0, 50.0, 1.0, 6.0) for g in (None, "a")}


def test_backlog(spark):
    arrivals = [(q, t // 2, k) for k, (q, t) in enumerate((q, t) for q in (None, "full", "free", "other") for t in range(9))]
    waiting = spark.createDataFrame([("full", 5), ("free", 2), (None, 4)], "q string, waiting long")
    found = O.within_backlog(spark.createDataFrame(arrivals, "q string, at long, id long"), waiting, ["q"], ["at", "id"], 5).collect()
    accepted = {q: sorted(r.id for r in found if r.q == q and r.accepted) for q in (None, "full", "free", "other")}
    assert accepted == {None: [0], "full": [], "free": [18, 19, 20], "other": [27, 28, 29, 30, 31]}
    assert len(found) == 36


@pytest.mark.parametrize("block", [4, 2048])
def test_tasks_that_make_pairs_are_counted_out(spark, monkeypatch, block):
    """Places of few and of many keys, null ones and repeats; partitions follow the rows, whatever their compressed bytes."""
    import random

    from quarryspark.operators import joins

    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "TASK_ROWS", 20)
    r = random.Random(2)
    rows = [(r.choice([*range(40), None]), r.choice([*range(30), None]), r.choice([0.1, 0.5, 0.9, None])) for _ in range(300)] + [(99, k % 25, 0.3) for k in range(60)]
    found = joins.co_occurring(spark.createDataFrame(rows, "p int, k int, c double"), "p", "k", "c")
    least: dict = {}
    for p, k, c in rows:
        if p is not None and k is not None:
            least.setdefault(p, {}).setdefault(k, []).extend([c] if c is not None else [])
    wanted: dict = {}
    for p, ks in least.items():
        for a in ks:
            for b in ks:
                if a < b:
                    wanted.setdefault((a, b), []).append((p, ks[a] + ks[b]))
    want = sorted((*ab, min(p for p, _ in xs), len(xs), min((c for _, cs in xs for c in cs), default=None)) for ab, xs in wanted.items())
    assert sorted(tuple(x) for x in found.collect()) == want
    assert found.rdd.getNumPartitions() > 8
