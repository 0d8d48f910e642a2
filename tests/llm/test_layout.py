"""The clustered layout against a brute-force version, with files of a few rows so that there are many blocks."""

import random
import zlib

import pytest
from support import DATA

from quarryspark.llm import clusterlayout
from quarryspark.llm.queries import op11_layout

AXES = ("source", "lang", "length", "date")


def brute(rows, per_file, reach=(0, 0, 2, 2), bins=16):
    """rows: (doc_id, source, lang, length, date); sorted results without what equal rows may swap."""
    rank = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    n, coords = len(rows), []
    for r in rows:
        coords.append(tuple(bins * sum(rank(o[1 + d]) < rank(r[1 + d]) for o in rows) // n for d in range(4)))
    z = [int("".join(f"{c[d]:04b}"[b] for b in range(4) for d in range(4)), 2) for c in coords]
    order = sorted(range(n), key=lambda i: (z[i], (rows[i][0] is not None, rows[i][0])))
    file_of = {i: p // per_file for p, i in enumerate(order)}
    inside = {}
    for i in order:
        inside.setdefault(file_of[i], []).append(coords[i])
    bounds = {f: [(min(c[d] for c in cs), max(c[d] for c in cs)) for d in range(4)] for f, cs in inside.items()}
    out = []
    for p, i in enumerate(order):
        box = [(coords[i][d] - reach[d], coords[i][d] + reach[d]) for d in range(4)]
        touched = sum(all(b[d][0] <= box[d][1] and b[d][1] >= box[d][0] for d in range(4)) for b in bounds.values())
        matching = sum(any(all(box[d][0] <= c[d] <= box[d][1] for d in range(4)) for c in cs) for cs in inside.values())
        out.append((rows[i][0], z[i], p, p // per_file, touched, matching, tuple(x for b in bounds[p // per_file] for x in b)))
    return out


def laid(frame, per_file):
    found = clusterlayout.lay_out(frame, "doc_id", list(AXES), (0, 0, 2, 2), per_file=per_file).collect()
    rows = [(r.doc_id, r.z, r.position, r.file, r.files_touched, r.files_matching, tuple(r[f"{e}{d}"] for d in range(4) for e in ("low", "high"))) for r in found]
    return sorted(rows, key=lambda r: r[2])


def _rows(n, seed):
    r = random.Random(seed)
    source = lambda: r.choice(["hot"] * 5 + ["a", "ä", "Z", "", None, "é\U0001f600", "￿"])
    return [(r.choice([None, k, k // 2]), source(), r.choice(["en", "de", None]), r.choice([-1, 0, 5, 5, 5, 1 << 40, r.randrange(1000)]), r.randrange(365)) for k in range(n)]


SCHEMA = "doc_id long, source string, lang string, length long, date long"


@pytest.mark.parametrize(("n", "per_file"), [(700, 9), (123, 1), (1, 5), (16, 1000)])
def test_equals_brute_force(spark, n, per_file):
    rows = _rows(n, n)
    assert laid(spark.createDataFrame(rows, SCHEMA), per_file) == brute(rows, per_file)


def test_all_rows_alike(spark):
    rows = [(7, "s", None, -1, 3)] * 50
    assert laid(spark.createDataFrame(rows, SCHEMA), 4) == brute(rows, 4)


def test_many_parts(spark, monkeypatch):
    """Equal rows are dealt over several range-sorted parts, too."""
    monkeypatch.setattr(clusterlayout, "PART_ROWS", 20)
    rows = [(None, "s", "x", 1, 1)] * 150 + _rows(150, 3)
    assert laid(spark.createDataFrame(rows, SCHEMA), 10) == brute(rows, 10)


def test_no_rows(spark, none):
    assert clusterlayout.document_layout(none).count() == 0


def test_odd_documents(spark, odd):
    """Null ids, nulls in all columns, a very long text and clashing names."""
    rows = [(r.doc_id, r.source, r.lang, -1 if r.text is None else len(r.text.encode()), zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 365) for r in odd.collect()]
    clash = odd.withColumnsRenamed({"n": "z", "words": "file", "score": "position", "key": "__tie"})
    found = clusterlayout.document_layout(clash, per_file=3).collect()
    wanted = brute(rows, 3)
    assert sorted((r.position, r.doc_id, r.z, r.files_touched, r.files_matching) for r in found if r.doc_id is not None) == sorted((w[2], w[0], w[1], w[4], w[5]) for w in wanted if w[0] is not None)
    assert len(found) == len(rows)


def test_too_many_cells(spark, odd):
    with pytest.raises(ValueError, match="cells"):
        clusterlayout.lay_out(odd, "doc_id", ["source", "lang", "n", "doc_id"], (0, 0, 1, 1), bins=64)


def test_query_against_sql(spark, duck):
    from support import same_rows

    from quarryspark.llm.queries import oracle_sql

    same_rows(op11_layout(spark, DATA), duck.sql(oracle_sql()["op11_layout"]))
