"""Near-duplicates by resemblance: the pipeline's form of near-deduplication.

Texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.

* Golay codes: fingerprints of two differing bits at most meet by the codeword keys of ``simhash`` and are linked first.
* Min-wise keys, for what is further apart: hashes of the shingle set, ``ROWS`` to each of ``BANDS`` keys. Two texts of
  similarity J share a key with probability 1 - (1 - J^6)^20: 0.998 at 0.8. That depends neither on the number of texts nor on
  where they differ (scattered words, a block appended, a tail cut). Codeword keys alone can't do this: at that similarity 15
  of 100 SimHash bits differ (README has the figures).
* Verification, of the links of either search: the exact similarity of both sets, of 64-bit hashes.

The texts of a key are compared with one of them, its representative, and those that turn out to be near copies are
contracted to a component. A key whose texts are in one component is done; a few rounds settle groups of any size
that hang together. Texts of a key that are still in different components meet in blocks, without those that are
connected anyway; so no link between components is lost, and no group is spelled out in pairs.

Defined results: nodes are texts (by a 128-bit hash of the lower-cased words), so texts of equal words are one, null and
blank ones too; a row belongs to the component of its text, whatever its id; a component has the smallest id of
its rows, null only if no row has one; an empty table gives no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpointed, small_side, written
from .components import connected_components, first_rows

#: Words to a shingle, and the similarity from which texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 6, 20
#: Equal bytes of two signatures below which a pair's exact similarity isn't computed in a block: six standard
#: errors under the 96 of 120 that are expected at the wanted similarity.
LEAST_EQUAL = 70
#: Rounds of representatives, and members of a block of what they leave over.
ROUNDS, BLOCK = 3, 256
#: Bytes of the long signatures of what the rounds leave over, and rows of a block of them.
LONG, LARGE = 512, 2048
_LONG_ODD = np.random.default_rng(6).integers(0, 1 << 32, LONG, dtype=np.uint32) | np.uint32(1)
_ODD = np.random.default_rng(5).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
#: Temporary columns.
_ID, _MARK = "__near_id", "__near_mark"


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts)), dtype=">u8").astype(np.uint64)


def _least(h: np.ndarray, odd: np.ndarray = _ODD) -> np.ndarray:
    """The least values of the features under each hash function."""
    least = np.full(len(odd), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 2048):  # in bounded room
        x = (h[at : at + 2048] >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (odd[:, None] * x).min(axis=1), out=least)
    return least


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """128-bit hash of the words, and the sorted hashes of the distinct shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    whole = xxhash.xxh3_128_digest(b" ".join(words))
    if not words:
        return whole, np.zeros(0, dtype=np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)))
    return whole, np.unique(_hashes(grams))


def sketch(text: str | None, shingle: int = SHINGLE) -> tuple[bytes, int, np.ndarray, bytes]:
    """128-bit hash of the words, number of shingles, search keys, and a byte of each min-wise hash."""
    whole, h = shingles(text, shingle)
    if not len(h):
        return whole, 0, np.zeros(0, dtype=np.int64), bytes(len(_ODD))
    least = _least(h)
    bands = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), seed=k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)
    return whole, len(h), keys, (least >> np.uint32(8)).astype(np.uint8).tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *arrays])))


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, n, keys, bytes, f); ``mark`` is Spark's own hash of the text, to find the row again, ``f`` the
    fingerprint of ``simhash``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                rows = [sketch(x) for x in texts]
                marks = np.array([simhash.text_fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)
                columns = [part.column("doc_id"), part.column("mark"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), _lists([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.binary()), pa.array(marks)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "n", "keys", "bytes", "f"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, mark long, node binary, n long, keys array<long>, bytes binary, f long")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of texts, each once."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # in bounded room
                rows = [shingles(x.as_py()) for x in batch.column("text").slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), _lists([np.sort(h.view(np.int64)) for _, h in rows])], names=["node", "shingles"])

    return texts.select("text").mapInArrow(run, "node binary, shingles array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) of those pairs (a, b) that have the wanted similarity."""
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(x, "a").join(y, "b")
    return met.where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of some sorted sets have the wanted similarity with one; none of them is empty."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *sizes[:-1]]))
    return both >= similarity * (len(one) + sizes - both) - 1e-9


def _forest(pdf: pd.DataFrame, split: int | None, similarity: float) -> pd.DataFrame:
    """Links that join near copies of different components: among all rows, or between those before ``split`` and
    the others."""
    marks = np.frombuffer(b"".join(pdf["bytes"]), dtype=np.uint8).reshape(len(pdf), -1)
    label = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
    sets, node, out = pdf["shingles"].tolist(), pdf["node"].to_numpy(), []
    for i in range(len(pdf) if split is None else split):
        first = i + 1 if split is None else split
        near = first + np.flatnonzero(label[first:] != label[i])
        near = near[(marks[near] == marks[i]).sum(axis=1) >= LEAST_EQUAL]
        for at in range(0, len(near), 64):
            part = near[at : at + 64]
            part = part[label[part] != label[i]]
            if len(part):
                for j in part[_alike(sets[i], [sets[j] for j in part], similarity)]:
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["src", "dst"])


def _suspects(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The nodes that may be near copies of one of another component, by sizes and signatures alone: among the rows of one block, or
    between those of the two blocks of a pair."""
    low, high = divmod(int(pdf["pair"].iloc[0]), 1 << 31)
    if low < high:
        pdf = pd.concat([pdf[pdf["large"] == low], pdf[pdf["large"] == high]])
    split = int((pdf["large"] == low).sum()) if low < high else len(pdf)
    marks = np.frombuffer(b"".join(pdf["bytes"]), dtype=np.uint8).reshape(len(pdf), -1)
    label, n = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1], pdf["n"].to_numpy()
    found = np.zeros(len(pdf), bool)
    least = similarity * LONG - 6 * (similarity * (1 - similarity) * LONG) ** 0.5  # six standard errors under what is expected
    for i in range(split):
        first = split if low < high else i + 1
        fits = np.minimum(n[first:], n[i]) >= similarity * np.maximum(n[first:], n[i]) - 1e-9
        near = first + np.flatnonzero((label[first:] != label[i]) & fits)
        near = near[np.count_nonzero(marks[near] == marks[i], axis=1) >= least]
        found[near] = True
        found[i] |= len(near) > 0
    return pdf.loc[found, ["key", "node"]]


def _long_signatures(sets: DataFrame) -> DataFrame:
    """(node, bytes) of sets of shingles: a byte of each of ``LONG`` min-wise hashes."""

    def run(batches):
        for batch in batches:
            marks = [(_least(x.values.to_numpy().view(np.uint64), _LONG_ODD) >> np.uint32(8)).astype(np.uint8).tobytes() for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(marks, pa.binary())], names=["node", "bytes"])

    return sets.select("node", "shingles").mapInArrow(run, "node binary, bytes binary")


def _suspected(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``members`` that ``_suspects`` finds in blocks of ``LARGE`` rows, which hold a long signature each and no shingles: texts that only
    share a template go no further."""
    signed = written(_long_signatures(sets.join(small_side(checkpointed(members.select("node").distinct())), "node", "left_semi")), "signatures")
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / LARGE).cast("int").alias("larges"))
    dealt = members.join(counts, "key").withColumn("large", F.pmod(F.xxhash64("node", F.lit(5)), F.col("larges")).cast("int"))
    pair = (F.least("large", "other").cast("long") * (1 << 31)) + F.greatest("large", "other")
    rows = dealt.join(signed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("larges") - 1))).withColumn("pair", pair)
    kept = rows.select("key", "node", "n", "root", "bytes", "large", "pair").groupBy("key", "pair").applyInPandas(lambda pdf: _suspects(pdf, similarity), "key long, node binary")
    found = checkpointed(kept.distinct())
    return checkpointed(members.join(small_side(found), ["key", "node"], "left_semi"))


def _within(similarity: float):
    """Links among the members of a block."""
    return lambda pdf: _forest(pdf, None, similarity)


def _across(similarity: float):
    """Links between the members of two blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf["block"] == pdf["pair"].iloc[0] // (1 << 31)
        return _forest(pd.concat([pdf[low], pdf[~low]]), int(low.sum()), similarity)

    return run


def _grown(rooted: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of all links so far, from the components before and the new links."""
    if rooted is not None:
        links = links.union(rooted.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    return connected_components(links)


def _unsettled(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """The (key, node, n, root) of those keys whose nodes are in several components by now."""
    now = rows.drop("root").join(small_side(rooted), "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = checkpointed(now.select("key", "node", "n", "root"))
    keys = checkpointed(now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"))
    return checkpointed(now.join(small_side(keys), "key"))


def _fits(a: str, b: str, similarity: float) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _fingerprint_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts that the Golay codes of ``simhash`` link: the first text of each fingerprint with those of
    fingerprints two bits away at most, and with the others of its own."""
    first = checkpointed(nodes.groupBy("f").agg(F.min(F.struct("node", "n")).alias("r")))
    other = lambda name: first.select(F.col("f").alias(name), F.col("r").alias(name + "_r"))
    near = simhash.links(first.select("f")).join(other("src"), "src").join(other("dst"), "dst").select(F.col("src_r.node").alias("a"), F.col("dst_r.node").alias("b"), F.col("src_r.n").alias("n"), F.col("dst_r.n").alias("m"))
    same = nodes.select("f", "node", "n").join(first, "f").where("node <> r.node").select(F.col("node").alias("a"), F.col("r.node").alias("b"), "n", F.col("r.n").alias("m"))
    return checkpointed(near.union(same).where(_fits("n", "m", similarity)).select("a", "b"))


def _links(docs: DataFrame, nodes: DataFrame, similarity: float, rounds: int, block: int) -> DataFrame:
    """(node, root) of the linked texts."""
    keys = nodes.select(F.explode("keys").alias("key"), "node", "n")
    groups = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("a"), F.max("node").alias("b"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("m > 1")
    groups = checkpointed(groups.groupBy("m", "a", "b", "sum").agg(F.min("key").alias("key")).select("key"))  # groups of the same members meet once
    members = written(keys.join(small_side(groups), "key").withColumn("root", F.col("node")), "members")
    marked = _fingerprint_pairs(nodes, similarity)
    # The shingles of texts that share a key or a fingerprint's neighbourhood, and of no others.
    sharing = small_side(checkpointed(members.select("node").union(marked.select("a")).union(marked.select("b")).distinct()))
    wanted = nodes.join(sharing, "node", "left_semi").select(F.col("first.doc_id").alias(_ID), F.col("first.mark").alias(_MARK))
    same = F.col("doc_id").eqNullSafe(F.col(_ID)) & (F.xxhash64("text") == F.col(_MARK))
    sets = written(_sets(docs.select("doc_id", "text").join(small_side(checkpointed(wanted)), same, "left_semi")), "shingles")
    rooted = checkpointed(_grown(None, written(_verified(marked, sets, similarity), "links")))
    members = _unsettled(members, rooted)
    for _ in range(rounds):
        one = small_side(checkpointed(members.groupBy("key").agg(F.min(F.struct("node", "n", "root")).alias("r"))))
        met = members.join(one, "key").where("node <> r.node")
        pairs = met.where(_fits("n", "r.n", similarity) & (F.col("root") != F.col("r.root"))).select(F.col("node").alias("a"), F.col("r.node").alias("b")).distinct()
        rooted = checkpointed(_grown(rooted, written(_verified(pairs, sets, similarity), "links")))
        members = _unsettled(met.select(*members.columns), rooted)
        if not members.limit(1).count():
            return rooted
    members = _suspected(members, sets, similarity)
    if not members.limit(1).count():
        return rooted
    # What is left, in blocks; larger groups' blocks in pairs, if they haven't been connected meanwhile.
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    full = lambda rows: rows.join(nodes.select("node", "bytes"), "node").join(sets, "node")
    own = full(dealt).groupBy("key", "block").applyInPandas(_within(similarity), "src binary, dst binary")
    rooted = checkpointed(_grown(rooted, written(own, "links")))
    dealt = _unsettled(members, rooted).join(counts.where("blocks > 1"), "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
    pair = (F.least("block", "other").cast("long") * (1 << 31)) + F.greatest("block", "other")
    if dealt.limit(1).count():
        met = full(dealt).withColumn("other", F.explode(others)).withColumn("pair", pair)
        more = met.groupBy("key", "pair").applyInPandas(_across(similarity), "src binary, dst binary")
        rooted = checkpointed(_grown(rooted, written(more, "links")))
    return rooted


def _rooted(docs: DataFrame, similarity: float, rounds: int, block: int) -> DataFrame:
    """(doc_id, mark, root) for every row of ``docs``."""
    marks = written(_sketches(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark"))
    nodes = written(marks.groupBy("node").agg(first.alias("first"), *[F.first(x).alias(x) for x in ("n", "keys", "bytes", "f")]), "texts")
    rooted = _links(docs, nodes, similarity, rounds, block)
    rows = marks.select("doc_id", "mark", "node").join(small_side(rooted.where("node <> root")), "node", "left")
    return written(rows.select("doc_id", "mark", F.coalesce("root", "node").alias("root")), "rooted")


def components(docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text)."""
    rows = _rooted(docs, similarity, rounds, block)
    least = checkpointed(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(small_side(least), "root").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component, as ``first_rows`` chooses it."""
    return first_rows(docs, _rooted(docs, similarity, rounds, block))
