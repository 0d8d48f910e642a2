"""Operators on documents: brute force, and odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryspark.llm import common, components, decontaminate, maxent, mixing, quality, sharding, similar, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def split(text):
    return (text or "").encode().lower().split()


# --- quality --------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "quality").toPandas()
    held = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]]
    assert ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.95
    assert all(0 <= s <= 1 for s in rows.score)


def test_quality_column_equals_numpy(spark, docs):
    r = np.random.default_rng(0)
    x = r.random((500, 3))
    model = quality.fit_rules(["a", "b", "c"], x, ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float))
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double")
    got = [row.s for row in frame.select(model.column(F.col).alias("s")).collect()]
    assert np.allclose(got, model.score(x)) and model.rules


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model, "q")
    assert got.count() == odd.count() and got.where("q between 0 and 1").count() == odd.count() and set(odd.columns) < set(got.columns)
    assert quality.score(none, model, "q").count() == 0
    flat = quality.train(none, labels)
    assert quality.score(odd, flat, "q").where("q = 0.5").count() == odd.count()


# --- near duplicates ------------------------------------------------------------------------------------------


def test_golay_keys_meet_within_two_bits():
    r = np.random.default_rng(1)
    f = r.integers(0, 2**63, 2000, dtype=np.int64)
    for n in (0, 1, 2):
        g = f.copy().view(np.uint64)
        for i in range(len(g)):
            for b in r.choice(64, n, replace=False):
                g[i] ^= np.uint64(1) << np.uint64(b)
        a, b = (set(zip(*map(np.ndarray.tolist, simhash.fuzzy_keys(x)), strict=True)) for x in (f, g.view(np.int64)))
        assert {i for i, _ in a & b} == set(range(len(f)))


def test_fingerprint_by_hand():
    import xxhash

    assert simhash.text_fingerprint(None) == simhash.text_fingerprint(" \n") == 0
    assert simhash.text_fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    text = "A b c d a b c É"
    h = [xxhash.xxh64_intdigest(b" ".join(split(text)[k : k + 3]), 42) for k in range(6)]
    assert simhash.text_fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 6)


def _groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_have_all_components(spark, bucket):
    """Also where every group is too large to be paired."""
    r = random.Random(3)
    marks = {r.getrandbits(63) for _ in range(60)}
    for m in list(marks):
        for _ in range(r.randrange(12)):
            m ^= 1 << r.randrange(63)
            marks.add(m)
    marks = sorted(marks)
    wanted = _groups([(a, b) for i, a in enumerate(marks) for b in marks[i + 1 :] if (a ^ b).bit_count() <= 2], marks)
    got = components.connected_components(simhash.links(spark.createDataFrame([(m,) for m in marks], "f long"), bucket=bucket))
    found = {n: n for n in marks} | {row.node: row.root for row in got.collect()}
    assert found == wanted


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_chains(spark, few):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long"), few=few).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long"), few=few).count() == 0


def test_simhash_odd_rows(odd, none):
    got = simhash.components(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert {by_id[k].component_id for k in (30, 31, 32)} == {30} and by_id[30].fingerprint_bits == 0
    assert by_id[None].component_id == 3 and by_id[33].component_id == 4 and by_id[35].component_id == 5
    kept = simhash.deduplicate(odd).select("doc_id").collect()
    assert len({r.doc_id for r in kept}) == len(kept) and simhash.components(none).count() == 0 == simhash.deduplicate(none).count()


def _near_copies(spark, copies):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows, k = [], 0
    for group in range(12):
        base = r.choices(vocabulary, k=300)
        for c in range(copies if group == 0 else 4):
            words = list(base)
            for _ in range(3 if c else 0):
                words[r.randrange(300)] = r.choice(vocabulary)
            rows.append((k, " ".join(words), group))
            k += 1
    return rows, spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")


@pytest.mark.parametrize("rounds, block", [(3, 256), (1, 16), (0, 16)])
def test_similar_finds_near_copies(spark, rounds, block):
    """Representatives, blocks, and pairs of blocks each find a group of sixty on their own."""
    rows, frame = _near_copies(spark, 60)
    got = {r.doc_id: r.component_id for r in similar.components(frame, rounds=max(rounds, 1), block=block).collect()}
    first = {}
    for k, _, g in rows:
        first.setdefault(g, k)
    assert got == {k: first[g] for k, _, g in rows}
    assert similar.deduplicate(frame, rounds=max(rounds, 1), block=block).count() == 12


def _all_pairs(texts):
    """Components by brute force: {place: least place}."""
    sets = [set(zip(*[t[k:] for k in range(5)], strict=False)) if len(t) >= 5 else {tuple(t)} for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return _groups(pairs, range(len(texts)))


@pytest.mark.parametrize("rounds, block", [(3, 256), (1, 8)])
def test_similar_keeps_close_groups_apart(spark, rounds, block):
    """Texts with a passage in common, of similarities around 0.8: many share keys and are no near copies, and some
    are linked only through members that aren't representatives."""
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(4000)]
    shared, texts = r.choices(vocabulary, k=100), []
    for _ in range(30):
        own = r.choices(vocabulary, k=r.randrange(5, 40))
        texts.append(shared + own)
        for _ in range(2):
            texts.append(shared + own + r.choices(vocabulary, k=r.randrange(0, 30)))
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    wanted = _all_pairs(texts)
    assert 3 < len(set(wanted.values())) < 60
    assert {x.doc_id: x.component_id for x in similar.components(frame, rounds=rounds, block=block).collect()} == wanted


def test_similar_links_by_golay_codes(spark):
    """Near copies of two differing bits at most are linked by their fingerprints' codewords, without any min-wise key;
    fingerprints that meet but differ in too many shingles aren't."""
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for _ in range(8):
        base = r.choices(vocabulary, k=400)
        near = [base[:k] + [r.choice(vocabulary)] + base[k + 1 :] for k in range(10, 400, 10)]
        mark = simhash.text_fingerprint(" ".join(base))
        close = [w for w in near if (simhash.text_fingerprint(" ".join(w)) ^ mark).bit_count() <= 2]
        texts += [base, *close[:3]]
    texts += [["same"] * 4, ["same"] * 40, ["same"] * 40 + ["x"]]  # nearly one fingerprint, unlike sets of shingles for the last
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    first = F.struct(F.lit(False).alias("no"), F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark"))
    nodes = similar._sketches(frame).groupBy("node").agg(first.alias("first"), *[F.first(x).alias(x) for x in ("n", "bytes", "f")]).withColumn("keys", F.array().cast("array<long>"))
    nodes = nodes.localCheckpoint()
    root = {x.node: x.root for x in similar._links(frame, nodes, 0.8, 3, 256).collect()}
    node = {x["first"].doc_id: x.node for x in nodes.collect()}
    got = [root.get(node[k], node[k]) for k in range(len(texts))]
    wanted = _all_pairs(texts)
    wanted_groups = {frozenset(k for k in wanted if wanted[k] == g) for g in wanted.values()}
    assert {frozenset(k for k in range(len(texts)) if got[k] == g) for g in got} == wanted_groups
    assert sum(len(g) > 1 for g in wanted_groups) >= 7


def test_similar_odd_rows(spark, odd, none):
    got = {r.doc_id: r.component_id for r in similar.components(odd).collect()}
    assert {got[k] for k in (30, 31, 32)} == {30} and got[None] == 3 and got[35] == got[5]
    kept = [r.doc_id for r in similar.deduplicate(odd).select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and None not in kept and similar.deduplicate(none).count() == 0
    # An id with two texts is in both components; text ids and odd names do as well.
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    named = spark.createDataFrame([("5", a, 1), ("5", b, 2), ("3", b, 3), (None, a, 4)], "doc_id string, text string, `a.b` int")
    assert sorted((r.doc_id, r["a.b"]) for r in similar.deduplicate(named).collect()) == [("3", 3), ("5", 1)]
    assert simhash.deduplicate(named).count() == 2


def _edited(r, words, kind, vocabulary):
    """A copy whose exact similarity is 0.80 to 0.86."""
    n = len(words)
    if kind == "appended":
        return words + r.choices(vocabulary, k=n * 20 // 100)
    if kind == "cut":
        return words[: n * 83 // 100]
    words = list(words)
    for k in r.sample(range(0, n, 5), n * 18 // 1000):
        words[k] = r.choice(vocabulary)
    return words


@pytest.mark.parametrize("kind", ["appended", "cut", "scattered"])
def test_similar_is_exact_for_every_edit(spark, kind):
    """Components are those of all pairs of an exact five-word similarity of 0.8, some just below it included."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(5000)]
    texts = []
    for k in range(150):
        words = r.choices(vocabulary, k=r.randrange(100, 400))
        texts += [words, _edited(r, words, kind, vocabulary)]
        texts += [words + r.choices(vocabulary, k=len(words) * 26 // 100)] if k % 3 == 0 else []
    wanted = _all_pairs(texts)
    assert len(set(wanted.values())) < len(texts) - 140
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in similar.components(frame).collect()} == wanted


# --- decontamination ------------------------------------------------------------------------------------------


def _best(doc, item):
    w, best = min(13, len(item)), (0, 0)
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= shift + i < len(doc) and doc[shift + i] == x for i, x in enumerate(item)]
        best = max([best, *[(sum(same[i : i + w]), w) for i in range(len(item) - w + 1)]])
    return best


def test_decontamination_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 4, 5, 6, 9, 10, 11, 12, 14, 30])))) for k in range(40)]
    docs = []
    for k in range(160):
        words = r.choices(vocabulary, k=60)
        if k % 2:
            part = items[k // 2 % 40][1].split()
            for _ in range(r.randrange(4)):
                part[r.randrange(len(part))] = "changed"
            words[10 : 10 + len(part)] = part
            words = words[r.choice([0, 11]) : r.choice([60, 9 + len(part)])]  # some begin or end in the item
        docs.append((k, " ".join(words)))
    docs.append((1000, "rep " * 500))
    items.append((100, "rep " * 20))
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_matched, x.n_window) for x in decontaminate.overlaps(frame, benchmark).collect()}
    wanted = {}
    for d, text in docs:
        for i, item in items:
            n, w = _best(text.split(), item.split())
            if w and n >= -(-w * 8 // 10):
                wanted[d, i] = (n, w)
    assert got == wanted
    again = decontaminate.overlaps(frame, benchmark, seed_rows=50).collect()  # in many passes
    assert {(x.doc_id, x.item_id): (x.n_matched, x.n_window) for x in again} == wanted
    assert {x.doc_id for x in decontaminate.decontaminate(frame, benchmark, most=0).collect()} == {d for d, _ in docs} - {d for d, _ in wanted}


def test_masks_hit_every_accepted_window():
    for n in range(1, 14):
        masks = [tuple(first + p for p in mask) for first, mask in (decontaminate.short_masks(n) if n < 13 else [(k, m) for m in decontaminate.MASKS for k in range(6)])]
        for least in itertools.combinations(range(n), n - -(-n * 8 // 10)):
            assert any(not set(mask) & set(least) for mask in masks), (n, least)


def test_decontamination_odd_rows(spark, odd, none):
    part = lambda k: " ".join(odd.where(f"doc_id = {k}").first().text.upper().split()[5:25])
    items = spark.createDataFrame([(1, part(6), 1), (2, None, 1), (3, "too short", 1), (None, part(7), 1), (4, part(3), 1)], "item_id long, text string, w int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(odd, items).collect()} == {(6, 1), (3, 4), (None, 4)}
    kept = decontaminate.decontaminate(odd, items)
    assert kept.count() == odd.count() - 4 and kept.columns == odd.columns
    assert decontaminate.overlaps(none, items).count() == 0 and decontaminate.overlaps(odd, items.limit(0)).count() == 0


def test_decontamination_of_a_text_full_of_hits(spark):
    """All 32,400 hits of one text of 19,980 words; rows of these with the words of the text would be 10 GB."""
    passage = " ".join(f"p{k}" for k in range(37))
    docs = spark.createDataFrame([(1, f"{passage} " * 540), (2, "other words " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    for seed_rows in (1000, 50):
        assert decontaminate.overlaps(docs, items, seed_rows=seed_rows).collect() == [(1, 7, 13, 13, 0)]
        assert [x.doc_id for x in decontaminate.decontaminate(docs, items, seed_rows=seed_rows).collect()] == [2]


def test_decontamination_joins_one_part_of_a_large_benchmark_at_a_time(spark):
    r = random.Random(3)
    items = spark.createDataFrame([(k, " ".join(f"w{r.randrange(900)}" for _ in range(40))) for k in range(60)], "item_id long, text string")
    docs = items.selectExpr("item_id * 10 AS doc_id", "concat('a b ', text, ' c') AS text")
    found, _ = decontaminate._found(docs, items, 500, 1 << 20)
    assert found.count() == 60 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_decontamination_sieve_passes_every_seed_of_the_benchmark_and_few_others(spark):
    seeds = spark.range(20_000).selectExpr("xxhash64(id) AS seed")
    sown = spark.range(200_000).selectExpr("id AS doc_id", "id AS mark", "array('a', 'b', 'c') AS w", "2 AS at", "xxhash64(id) AS seed")
    passed = decontaminate._sifted(sown, seeds, 20_000)
    assert passed.where("doc_id < 20000").count() == 20_000 and passed.where("doc_id >= 20000").count() < 2_000
    assert passed.where("w[here] = 'c'").count() == passed.count()


# --- language model -------------------------------------------------------------------------------------------


def test_maxent_counts_and_gain(docs):
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in maxent.score(docs, steps=6).collect()}
    tokens = {r.doc_id: [*split(r.text), b"\n"] for r in rows}
    seen = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in ts)
    n, v = sum(seen.values()), len(seen)
    gain = 0.0
    for i, ts in tokens.items():
        g = got[i]
        assert g.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and g.n_tokens == len(ts) and g.train_tokens == n
        assert g.n_known == sum(seen[t] > 0 for t in ts)
        assert g.base_score == pytest.approx(sum(log10((seen[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        if g.held_out:
            gain += g.score - g.base_score
    assert gain > 0


def test_maxent_is_a_distribution():
    """Over all words of the model, and in each context, probabilities sum up to one."""
    r = np.random.default_rng(0)
    classes = maxent.make_classes(r.integers(0, 50, (maxent.LAST + 1, maxent.PAD)).astype(float))
    weights = [r.normal(size=(rows, width)) for rows, width in zip(maxent.ROWS, (classes.n, classes.width), strict=True)]
    scorer = maxent.Scorer(classes, weights, np.zeros(maxent.SHAPES))
    words = np.arange(maxent.PAD)
    for h in ([5, 7, 9], [maxent.PAD] * 3, [1200, 3, maxent.PAD]):
        h1, h2, h3 = (np.full(len(words), x) for x in h)
        own = classes.cls[words]
        p = scorer._get(0, classes.code(h1, h2, h3), own) + scorer._get(1, classes.word_code(own, h1, h2), classes.place[words])
        assert (10**p).sum() == pytest.approx(1, abs=1e-4)


def test_maxent_odd_rows(odd, none):
    got = {r.doc_id: r for r in maxent.score(odd, steps=2).collect()}
    assert len(got) == odd.select("doc_id").distinct().count() and got[30].n_tokens == got[31].n_tokens == 1
    assert got[34].n_tokens == 60_001 and all(r.score < 0 for r in got.values())
    assert maxent.score(none, steps=1).count() == 0
    alone = maxent.score(odd.where("doc_id = 5"), fold=zlib.crc32(b"5") % 5, steps=1).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.base_score == 0 and alone.score < 0


# --- mixing and sharding --------------------------------------------------------------------------------------


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in names if s not in capped))
        aim = {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        more = {s for s in names if s not in capped and aim[s] > 2 * sizes[s]}
        if not more:
            return aim
        capped |= more


def _mixed(rows):
    """(id, source, size) -> sorted words taken, by the global order of virtual time, cut at 1."""
    queue = sorted(((hashlib.md5(f"mix-1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id is not None, r.doc_id or 0, len(split(r.text)), r.source) for r in rows))
    sizes, before, events = Counter(), Counter(), []
    for *_, size, source in queue:
        sizes[source] += size
    aim = _targets(sizes)
    for copy in range(2):
        for n, (_, _, i, size, source) in enumerate(queue):
            middle = before[source] + size / 2
            before[source] += size
            if aim[source]:
                events.append((middle / aim[source], n, size))
    taken = Counter()
    for at, n, size in sorted(events):
        if at > 1:
            break
        taken[n] += size
    out = {}
    for n, (_, known, i, size, source) in enumerate(queue):
        out.setdefault((i if known else None, source, size), []).append(taken[n])
    return {k: sorted(v) for k, v in out.items()}, sizes, aim


@pytest.mark.parametrize("step", [10_000, 1])
def test_mixing_by_hand(odd, docs, none, monkeypatch, step):
    if step == 1:  # repeated rows are dealt in blocks
        monkeypatch.setattr(mixing, "spelled_out", lambda items, n, out: common.spelled_out(items, n, out, step))
    for frame in (docs, odd, odd.union(odd).union(odd)):
        got, rows = mixing.mix(frame).collect(), frame.collect()
        wanted, sizes, aim = _mixed(rows)
        taken, found = Counter(), {}
        for r in got:
            assert r.target == pytest.approx(aim[r.source]) and r.source_size == sizes[r.source]
            taken[r.source] += r.taken
            found.setdefault((r.doc_id, r.source, r.size), []).append(r.taken)
        assert {k: sorted(v) for k, v in found.items()} == wanted
        largest = {s: max(r.size for r in got if r.source == s) for s in sizes}
        assert all(abs(taken[s] - aim[s]) <= largest[s] / 2 + 1 for s in sizes) and len(got) == len(rows)
        times = [r.finish for r in got]
        assert times == sorted(times)
        for most in (None, 0):
            out = mixing.mixed_documents(frame, most=most)
            texts = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
            assert set(texts) <= {(r.doc_id, r.text) for r in rows} and out.columns == frame.columns
            assert sum(len(split(t)) * n for (_, t), n in texts.items()) == sum(taken.values())
    again = [tuple(r) for r in mixing.mix(docs.repartition(3)).select("doc_id", "taken").collect()]
    assert sorted(again) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
    assert mixing.mix(none).count() == 0 == mixing.mixed_documents(none).count()


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1}, {None: 7, "x": 0, "y": 3}, {f"s{k}": 3**k % 101 for k in range(40)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(_targets(sizes))


def _shards(rows, shards=8):
    """(id, crc) -> sorted (shard, slot), by ranking and sorting everything."""
    key = lambda r: hashlib.md5(f"shard-1:{'' if r.doc_id is None else r.doc_id}:{zlib.crc32((r.text or '').encode())}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (key(r), r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode())))
    n, rank, placed = Counter(r.source for r in rows), Counter(), []
    for r in rows:
        rank[r.source] += 1
        placed.append(((rank[r.source] - 0.5) / n[r.source], r.source is not None, r.source or "", key(r), r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode())))
    out = {}
    for at, (*_, known, i, crc) in enumerate(sorted(placed)):
        shard = at * shards // len(rows)
        out.setdefault((i if known else None, crc), []).append((shard, at - -(-shard * len(rows) // shards)))
    return {k: sorted(v) for k, v in out.items()}


def test_sharding_by_hand(docs, odd, none):
    for frame in (docs, odd, odd.union(odd).union(odd)):
        rows, found, kept = frame.collect(), {}, {}
        wanted = _shards(rows)
        for r in sharding.assign(frame).collect():
            found.setdefault((r.doc_id, r.text_crc32), []).append((r.shard, r.slot))
        assert {k: sorted(v) for k, v in found.items()} == wanted
        for most in (None, 0):
            got = sharding.sharded_documents(frame, most=most)
            kept = {}
            for r in got.collect():
                kept.setdefault((r.doc_id, zlib.crc32((r.text or "").encode())), []).append((r.shard, r.slot))
            assert {k: sorted(v) for k, v in kept.items()} == wanted and got.columns == [*frame.columns, "shard", "slot"]
    mapped = odd.withColumn("a.b", F.create_map(F.lit("x"), F.lit(1)))  # what can't be ordered, and odd names
    assert sharding.sharded_documents(mapped).columns == [*mapped.columns, "shard", "slot"]
    assert sharding.assign(none).count() == 0 == sharding.sharded_documents(none).count()
