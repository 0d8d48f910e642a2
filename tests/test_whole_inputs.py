"""Queries read whole texts and all rows."""

from quarryspark.plans import QUERIES


def _documents(spark, folder, texts):
    rows = [(k, x, "en", "s0", len(x)) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_phrases_of_a_long_text(spark, tmp_path):
    text = ". ".join(f"Common words {k}" for k in range(300)) + ". Zebra Crossing"
    at = _documents(spark, tmp_path, [text])
    terms = {r.term.lower() for r in QUERIES["phrase_keywords"](spark, at).collect()}
    assert any("zebra" in x for x in terms)


def test_spans_of_a_long_text(spark, tmp_path):
    """Tokens of two letters, three apart, never overlap: each is kept."""
    at = _documents(spark, tmp_path, [" ".join(["ab"] * 1000), " ".join(["ab"] * 10)])
    assert sorted(r["count"] for r in QUERIES["span_deoverlap"](spark, at).groupBy("doc_id").count().collect()) == [10, 1000]


def test_context_of_every_document(spark, tmp_path):
    at = _documents(spark, tmp_path, [f"text {k} of a few words" for k in range(60)])
    assert {r.doc_id for r in QUERIES["context_budget"](spark, at).collect()} == set(range(60))


def test_places_of_whole_texts_only(spark, tmp_path):
    """A place late in a text is found, and none that the text hasn't got."""
    at = _documents(spark, tmp_path, ["plain words " * 50 + "in meeting room B-3 or 1011 Fő utca 5. in Győr.", "plain words"])
    assert {r.doc_id for r in QUERIES["place_mentions"](spark, at).collect()} == {0}


def test_spans_without_overlaps_by_hand(spark):
    """Two keys, null ones, empty spans and repeats, against a walk over all kept spans."""
    import random

    from pyspark.sql import functions as F

    from quarryspark.operators import ordered as O

    r = random.Random(6)
    rows = [(r.choice([1, 2, None]), r.choice("ab"), s, s + r.randrange(6)) for s in (r.randrange(60) for _ in range(200))]
    frame = spark.createDataFrame(rows, "k int, x string, s long, e long")
    got = sorted(map(str, map(tuple, O.without_overlaps(frame, ["k", "x"], "s", "e", [-(F.col("e") - F.col("s")), F.col("s")]).collect())))
    wanted = []
    for group in {(k, x) for k, x, _, _ in rows}:
        kept = []
        for s, e in sorted(((s, e) for k, x, s, e in rows if (k, x) == group), key=lambda z: (z[0] - z[1], z[0], z[0], z[1])):
            before = [z for z in sorted(kept) if z[0] < e]
            if not before or before[-1][1] <= s:
                kept.append((s, e))
        wanted += [str((*group, *z)) for z in kept]
    assert got == sorted(wanted)
