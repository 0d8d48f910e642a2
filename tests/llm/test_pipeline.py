"""The pipeline's stages, each against a plain version on its own input, and with odd rows."""

import pytest
from support import DATA

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The test tables, with part of two texts as further items of the benchmark."""
    at = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    own = [(10_000 + k, " ".join(r.text.split()[3:30])) for k, r in enumerate(docs.where("n_chars > 600").orderBy("doc_id").limit(2).collect())]
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items.unionByName(spark.createDataFrame(own, "item_id long, text string")).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def stage(spark, name, docs, folder):
    out = STAGES[name](spark, docs, folder)
    assert out.columns == [*docs.columns, *(["shard", "slot"] if name == "sharding" else [])]
    return out.collect()


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_quality(spark, docs, folder):
    from quarryspark.llm import quality

    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    names = list(model.names)
    import numpy as np
    from pyspark.sql import functions as F

    frame = quality._with_statistics(docs, "text").select("doc_id", *[F.col(f"__quality_stats.{n}").alias(n) for n in names]).toPandas()
    kept = set(frame.doc_id[model.score(frame[names].to_numpy(np.float64)) >= corpus_pipeline.MIN_QUALITY])
    assert {r.doc_id for r in stage(spark, "quality", docs, folder)} == kept and 0 < len(kept) < docs.count()


def test_near_duplicates(spark, docs, folder):
    """One of each component of all pairs of similar shingle sets."""
    rows = docs.orderBy("doc_id").collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w)} if len(w) < 5 else set(zip(*[w[k:] for k in range(5)], strict=False)))
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    wanted = {rows[k].doc_id for k in set(root)}
    assert {r.doc_id for r in stage(spark, "near_duplicates", docs, folder)} == wanted and len(wanted) < len(rows)


def test_decontamination(spark, docs, folder):
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    at = {}
    for i, item in enumerate(items):
        for k, w in enumerate(item):
            at.setdefault(w, []).append((i, k))
    leaks = set()
    for r in docs.collect():
        text, hits = words(r.text), {}
        for p, w in enumerate(text):
            for i, k in at.get(w, ()):
                hits.setdefault((i, p - k), set()).add(k)
        for (i, _), places in hits.items():
            width = min(13, len(items[i]))
            if any(sum(b <= k < b + width for k in places) >= 0.8 * width for b in range(len(items[i]) - width + 1)):
                leaks.add(r.doc_id)
    assert {r.doc_id for r in stage(spark, "decontamination", docs, folder)} == {r.doc_id for r in docs.collect()} - leaks and len(leaks) >= 2


def test_decontamination_of_a_text_full_of_hits(spark, tmp_path):
    """All 32,400 hits of one text of 19,980 words; rows of these with the words of the text would be 10 GB."""
    passage = " ".join(f"p{k}" for k in range(37))
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"{passage} " * 540), (2, "other words " * 20)], "doc_id long, text string")
    assert [r.doc_id for r in stage(spark, "decontamination", docs, str(tmp_path))] == [2]


def test_mixing(spark, docs, folder):
    from collections import Counter

    from quarryspark.llm import mixing

    wanted = Counter()
    for r in mixing.mix(docs).collect():
        wanted[r.doc_id] += r.taken // r.size if r.size else 1
    assert Counter(r.doc_id for r in stage(spark, "mixing", docs, folder)) == +wanted


def test_sharding(spark, docs, folder):
    got = stage(spark, "sharding", docs.union(docs.limit(20)), folder)
    shards = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    assert len(got) == docs.count() + 20 and all(s == list(range(len(s))) for s in shards)
    assert max(map(len, shards)) - min(map(len, shards)) <= 1


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, odd, none, folder, name):
    """Nulls, blanks, repeats, a very long text and clashing columns; and nothing at all."""
    named = odd.withColumnRenamed("key", "a.b")
    got = stage(spark, name, named, folder)
    assert got and stage(spark, name, none, folder) == []
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    if name == "decontamination":
        assert len(got) == odd.count()
    if name == "near_duplicates":
        assert len(ids) == len(set(ids)) and (False, 0) not in ids and (True, 31) not in ids
    if name == "sharding":
        assert len(got) == odd.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert out.columns == [*docs.columns, "shard", "slot"] and 0 < out.count()
    bad = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0")
    assert out.join(bad, "doc_id").count() < 0.1 * bad.count() + 2
