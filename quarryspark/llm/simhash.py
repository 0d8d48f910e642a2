"""SimHash near-deduplication by Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments (22, 21 and 21 bits). If two fingerprints differ in at most two
bits, some pair of segments in cyclic order has no error in the first and at most one in the second
(pigeonhole). So each fingerprint gets, for each of the three pairs, keys made of the first segment as it
is and, for the second, the indices of all words of the binary Golay code [23, 12, 7] within distance 4:
two words that differ in one bit always have such a codeword in common. There is one codeword for a
segment within distance 2 of the code, and six (at distances 3, 4, 4, 4, 4, 4) for one at distance 3.
Fingerprints that meet in a key are verified by their true distance.

A key with more than ``BUCKET`` fingerprints isn't paired: its fingerprints are linked through common
neighbours instead. Two fingerprints differ in at most two bits exactly if they or their one-bit flips
coincide somewhere, so 65 rows for each (itself and 64 flips), grouped, link the same pairs in linear
room. Copies of a text share a fingerprint and cost nothing here: only distinct fingerprints are joined.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated rows and
ties link by their equal fingerprints; a null id gets its component (null if no member has an id); an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_side
from .components import connected_components, first_rows

#: Words to a shingle, and differing bits at which fingerprints link.
SHINGLE, BITS = 3, 2
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are paired directly; beyond, they are linked through their neighbours.
BUCKET = 32
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text: bit k is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) > shingle:
        joined = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    else:
        joined = [b" ".join(words)]
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(x, 42) for x in joined]), dtype=np.uint8).reshape(-1, 8)
    n, counts = len(digests), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):  # very long texts in bounded room
        counts += np.unpackbits(digests[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint_bits") -> DataFrame:
    """``docs`` without ``text``, with the fingerprint as a signed long in ``out``."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*others, F.lit(0).cast("long").alias(out)).schema

    def run(batches):
        for batch in batches:
            marks = np.array([text_fingerprint(x) for x in batch.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(marks)], names=[*others, out])

    return docs.select(*others, text).mapInArrow(run, schema)


# --- the code ---------------------------------------------------------------------------------------------


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator; zero for codewords."""
    v = v.copy()
    for k in range(22, 10, -1):
        v ^= np.where((v >> k) & 1, _GENERATOR << (k - 11), 0)
    return v


def _error_patterns() -> np.ndarray:
    """For each syndrome, the errors of weight 4 at most that lead to it: 1 or 6, padded with the first."""
    from itertools import combinations

    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], dtype=np.int64)
        for e, s in zip(errors.tolist(), _syndromes(errors).tolist(), strict=True):
            if weight < 4 or found[s][0].bit_count() == 3:
                found[s].append(e)
    return np.array([x + x[:1] * (6 - len(x)) for x in found], dtype=np.int64)


_PATTERNS: np.ndarray | None = None


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6): 12-bit indices of the codewords within distance 4 of each 23-bit word, repeated where fewer."""
    global _PATTERNS
    if _PATTERNS is None:
        _PATTERNS = _error_patterns()
    segment = segment.astype(np.int64)
    return (segment[:, None] ^ _PATTERNS[_syndromes(segment)]) >> 11


def fuzzy_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For an array of fingerprints: row numbers and keys, without repeats for a row."""
    u = bits.view(np.uint64) if bits.dtype == np.int64 else bits.astype(np.uint64)
    part = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        indices = codeword_indices(part[(k + 1) % 3])
        key = (np.int64(k) << 34) | (part[k][:, None] << 12) | indices
        fresh = np.ones(key.shape, dtype=bool)
        fresh[:, 1:] = indices[:, 1:] != indices[:, :1]
        at = np.nonzero(fresh)
        rows.append(at[0])
        keys.append(key[fresh])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(marks: DataFrame) -> DataFrame:
    """(key, f) for the distinct fingerprints in column ``f``."""

    def run(batches):
        for batch in batches:
            f = batch.column("f").to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys = fuzzy_keys(f)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[rows])], names=["key", "f"])

    return marks.select("f").mapInArrow(run, "key long, f long")


def neighbour_links(marks: DataFrame) -> DataFrame:
    """Star links (src, dst) with the same components as all pairs of fingerprints within two bits, by
    grouping each with its one-bit flips: those that meet at a common neighbour differ in two bits at most."""
    ball = marks.select("f", F.explode(F.expr("concat(array(f), transform(sequence(0, 63), k -> f ^ shiftleft(1L, k)))")).alias("at"))
    met = ball.groupBy("at").agg(F.min("f").alias("dst"), F.count("*").alias("n")).where("n > 1").select("at", "dst")
    return ball.join(met, "at").where("f > dst").select(F.col("f").alias("src"), "dst").distinct()


def links(marks: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (src, dst) between the distinct fingerprints of ``marks`` (column ``f``): all pairs that meet
    in a key of at most ``bucket`` fingerprints and differ in at most ``bits`` bits, and star links with the
    same components for larger keys."""
    if bits > 2:
        raise ValueError("the segments and the code provide for two differing bits at most")
    rows = checkpointed(keyed(marks))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("f").alias("low"), F.max("f").alias("high")).where("n > 1")
    sizes = checkpointed(sizes)
    twos = sizes.where("n = 2").select(F.col("low").alias("src"), F.col("high").alias("dst"))
    some = rows.join(sizes.where(F.col("n").between(3, bucket)).select("key"), "key")
    # At most ``bucket`` fingerprints of a key, so the lists and their pairs are bounded.
    pairs = some.groupBy("key").agg(F.collect_list("f").alias("fs")).select(F.explode(F.expr(f"flatten(transform(fs, a -> transform(filter(fs, b -> b > a and bit_count(a ^ b) <= {bits}), b -> struct(a as src, b as dst))))")).alias("p")).select("p.src", "p.dst")
    near = twos.where(F.expr(f"bit_count(src ^ dst) <= {bits}")).union(pairs).distinct()
    large = sizes.where(F.col("n") > bucket).select("key")
    crowded = rows.join(large, "key").select("f").distinct()
    return near.union(neighbour_links(crowded))


def _rooted(docs: DataFrame, bits: int, bucket: int) -> DataFrame:
    """(doc_id, mark, fingerprint_bits, root, component_id) for every row of ``docs``."""
    marks = checkpointed(fingerprints(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")))
    distinct = checkpointed(marks.groupBy(F.col("fingerprint_bits").alias("f")).agg(F.min("doc_id").alias("first")))
    joined = connected_components(links(distinct, bits, bucket))  # node -> root, of linked fingerprints only
    rooted = distinct.join(joined, distinct["f"] == joined["node"], "left").select("f", "first", F.coalesce("root", "f").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_mark = checkpointed(rooted.join(smallest, "root").select(F.col("f").alias("fingerprint_bits"), "root", "component_id"))
    return marks.join(small_side(by_mark), "fingerprint_bits")


def components(docs: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint_bits, component_id) for every row of ``docs`` (doc_id, text)."""
    return _rooted(docs, bits, bucket).select("doc_id", "fingerprint_bits", "component_id")


def deduplicate(docs: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component, as ``first_rows`` chooses it."""
    return first_rows(docs, checkpointed(_rooted(docs, bits, bucket)))


def fingerprint_hex(bits: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
