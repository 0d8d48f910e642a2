"""Vector codes against plain Lloyd rounds in whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from support import DATA, same_rows

from quarryspark.llm import vectorcodes
from quarryspark.llm.queries import op13_codes, oracle_sql


def brute(rows, parts, entries, rounds, scale=1024):
    """rows: (id, vector, label), ordered by (id, vector); (codes and errors by row, books)."""
    whole = [[math.floor(x * scale) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[tuple(w[p * width : (p + 1) * width]) for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda j: (far(x, book[j]), j))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p]) for c in cut]
            for j in range(len(books[p])):
                if members := [c[p] for c, k in zip(cut, own, strict=True) if k == j]:
                    books[p][j] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    return codes, errors, books


def _rows(n, dimension, seed, steps):
    """Few distinct components, so that there are many equal distances and equal vectors."""
    r = np.random.default_rng(seed)
    return [(int(k // 2 * 2), [float(x) for x in r.integers(-steps, steps, dimension) / 1024.0 * 3], int(k % 3) if k % 5 else None) for k in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("n", "dimension", "steps", "entries", "parts"), [(400, 8, 2, 16, 4), (300, 16, 300, 20, 4), (90, 4, 2, 256, 2), (1, 4, 9, 8, 4), (500, 4, 4, 12, 1)])
def test_equals_plain_rounds(spark, n, dimension, steps, entries, parts):
    rows = sorted(_rows(n, dimension, n, steps), key=lambda r: (r[0], r[1]))
    codes, errors, books = brute(rows, parts, entries, 4)
    found, got = vectorcodes.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=parts, entries=entries)
    assert [b.tolist() for b in got] == [[list(e) for e in b] for b in books]
    want = sorted((r[0], tuple(c), e) for r, c, e in zip(rows, codes, errors, strict=True))
    assert sorted((r["__id"], tuple(r.code), r.error) for r in found.collect()) == want
    assert vectorcodes.books_digest(got) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("steps", [3, 4000])
def test_bounds_keep_every_tie(steps):
    """Round by round the kept entries equal a full scan; most rows aren't scanned once entries settle."""
    r = np.random.default_rng(steps)
    x = r.integers(-steps, steps, (3000, 6)).astype(np.int64)
    book, before, code = x[:40].copy(), None, np.full(3000, -1)
    upper, lower, scans = np.zeros(3000), np.zeros(3000), []
    for _ in range(12):
        scans.append(vectorcodes.Codebook(book, before).assign(x, code, upper, lower))
        full = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (code == full.argmin(1)).all()
        before, book = book, np.array([x[code == j].sum(0) // max((code == j).sum(), 1) if (code == j).any() else book[j] for j in range(40)])
    assert scans[0] == 3000
    if steps > 1000:
        assert scans[-1] < 2400


def test_odd_rows(spark):
    """Nulls, non-finite components, other lengths, repeats, null ids and labels, clashing names."""
    good = [(5, [0.5, -0.25], 1, 1, "x"), (5, [0.5, -0.25], 1, 1, "x"), (None, [0.1, 0.2], None, 2, "y"), (7, [-0.001, 0.0], None, 3, "z")]
    bad = [(1, None, 1, 1, "x"), (2, [0.1, None], 1, 1, "x"), (3, [float("nan"), 0.1], 1, 1, "x"), (4, [float("inf"), 0.1], 1, 1, "x"), (6, [], 1, 1, "x"), (8, [0.1], 1, 1, "x"), (9, [0.1, float("-inf")], None, 1, "x")]
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int, code int, `error` string")
    found, books = vectorcodes.encode(rows, parts=2, entries=2)
    out = vectorcodes.label_errors(found).collect()
    assert sorted(str(r["__id"]) for r in out) == ["5", "5", "7", "None"]
    sums = {}
    for r in out:
        sums[r["__label"]] = sums.get(r["__label"], 0) + r.error
    assert all(r.label_error == sums[r["__label"]] for r in out)
    apart = vectorcodes.label_errors(found, most=0).collect()
    assert sorted(map(str, apart)) == sorted(map(str, out))


def test_rare_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "HOT_SHARE", 3)
    codes = spark.createDataFrame([(k, None if k < 40 else k % 30, k) for k in range(100)], "__id long, __label int, error long")
    found = {(r["__id"], r.label_error) for r in vectorcodes.label_errors(codes, most=0).collect()}
    assert found == {(r["__id"], r.label_error) for r in vectorcodes.label_errors(codes).collect()}
    assert len(found) == 100


def test_no_rows(spark):
    found, books = vectorcodes.encode(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and not books
    assert vectorcodes.label_errors(found).count() == 0


def test_refusals(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.encode(spark.createDataFrame([(1, [0.1] * 6, 1)], SCHEMA))
    with pytest.raises(ValueError, match="too large"):
        vectorcodes.encode(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA))


def test_large_components_in_longs(spark):
    rows = [(k, [float(k * 3_000_001 % 300_007), -float(k % 7)], 1) for k in range(60)]
    found, books = vectorcodes.encode(spark.createDataFrame(rows, SCHEMA), parts=2, entries=5)
    codes, errors, want = brute(rows, 2, 5, 4)
    assert [b.tolist() for b in books] == [[list(e) for e in b] for b in want]
    assert sorted((r["__id"], r.error) for r in found.collect()) == sorted((r[0], e) for r, e in zip(rows, errors, strict=True))


def test_query_against_sql(spark, duck):
    same_rows(op13_codes(spark, DATA), duck.sql(oracle_sql()["op13_codes"]))
