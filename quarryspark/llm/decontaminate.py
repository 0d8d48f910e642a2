"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask names the positions of a token window that count; the others may hold anything. The tokens under
each mask, at every position of every training text, are hashed and joined with the same hashes of the
benchmark. Each hit fixes an alignment of a text with an item; the aligned tokens around it are compared one by
one, and it is an overlap if some window of ``WINDOW`` item tokens (all of a shorter item) has at least ``AGREE``
of them equal in place.

No such overlap is missed. Two masks together hit every window of 13 tokens with up to two tokens replaced,
wherever they are. In a shorter item of n tokens, of which r may be replaced, the masks are the r + 1 sets of every
(r + 1)-th position: one of them holds no replaced token. Only the masks that the benchmark's items need are
hashed. A text may begin or end inside the item; tokens that it lacks count as replaced.

The seeds and tokens of the benchmark are broadcast, and texts are split once; no text, position or hit is
shuffled, only overlaps already found. A benchmark beyond the bounds of one broadcast takes several, one after
another: a sieve of bits, which passes every seed of the benchmark and few others, first leaves the places of the
texts that may hit, each with the tokens around it, and the parts of the benchmark are joined with these alone.
Hits are compared where they arise, in one generated loop with the join: a row that keeps the words of its text is
never put aside, however many hits a text has.

Defined results: tokens are lower-cased words between white space; null and blank texts and items have none, and
match nothing. Rows of one doc_id (null is one, too) give one result for each item; items of one item_id as well,
of those with a null item_id none is reported, though they do remove documents. Empty tables give no rows. Other
columns don't matter, whatever their names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_side, word_array

#: Token positions that count, in each mask for windows of 13 tokens.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 1 + max(p for mask in MASKS for p in mask)
#: Item tokens compared at once, and the share of them that must agree (11 of 13).
WINDOW, AGREE = 13, 0.8
#: Tokens before and behind the first one of a seed that its windows reach.
REACH = WINDOW - 1
#: Seeds, and characters of items, that are broadcast at once; further ones take further passes.
SEED_ROWS, ITEM_CHARS = 500_000, 16 << 20
#: Words of 64 bits of the sieve for each seed, at most (16 MB), and in a row of it.
SIEVE_WORDS, SIEVE_MOST, SIEVE_ROW = 0.5, 1 << 21, 1 << 11
_ID, _MARK = "__leak_id", "__leak_mark"
#: What one agreeing token counts in ``_best``; positions are less than half of it.
_MATCHED = 1 << 40


def short_masks(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(first position, mask from there) for an item of ``n`` tokens, fewer than ``WINDOW``."""
    parts = n - math.ceil(n * AGREE - 1e-9) + 1
    return [(k, tuple(range(0, n - k, parts))) for k in range(parts)]


#: All masks, by number: those of long items, then of short ones.
PATTERNS = tuple(dict.fromkeys([*MASKS, *[mask for n in range(1, WINDOW) for _, mask in short_masks(n)]]))


def _seed(words: Column, at: Column, k: int) -> Column:
    """The hash under mask ``k`` at a position; null if the mask goes beyond the text."""
    token = lambda p: F.get(words, at + p)
    return F.when(token(PATTERNS[k][-1]).isNotNull(), F.xxhash64(F.lit(k), *[token(p) for p in PATTERNS[k]]))


def _items(benchmark: DataFrame) -> DataFrame:
    """(no, item): the distinct token arrays of the items, numbered."""
    words = benchmark.select(word_array(F.lower(F.col("text"))).alias("item")).where(F.size("item") > 0).distinct()
    return checkpointed(words.select(F.monotonically_increasing_id().alias("no"), "item"))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(no, mask, item_at, seed) of each item, by the masks that its length needs."""
    n = F.size("item")
    place = lambda k, at: F.struct(F.lit(k).alias("mask"), at.cast("int").alias("item_at"))
    places = F.flatten(F.transform(F.sequence(F.lit(0), n - SPAN), lambda p: F.array(*[place(k, p) for k in range(len(MASKS))])))
    places = F.when(n >= WINDOW, places)
    for length in range(1, WINDOW):
        places = places.when(n == length, F.array(*[place(PATTERNS.index(mask), F.lit(first)) for first, mask in short_masks(length)]))
    rows = items.select("no", "item", F.explode(places).alias("p")).select("no", "item", "p.*")
    seed = F.coalesce(*[F.when(F.col("mask") == k, _seed(F.col("item"), F.col("item_at"), k)) for k in range(len(PATTERNS))])
    return checkpointed(rows.select("no", "mask", "item_at", seed.alias("seed")))


def _one(value: Column, name: str) -> Column:
    """``value``, computed once in a method of its own: a filter doesn't repeat it, and the method stays short enough (8,000
    bytes) to be compiled."""
    return F.explode(F.array(value)).alias(name)


def _same(places: range) -> Column:
    """Bit k is set if the token at k - ``REACH`` from the seed's first is the same in text and item."""
    same = lambda k: F.get(F.col("w"), F.col("here") + (k - REACH)) == F.get(F.col("item"), F.col("item_at") + (k - REACH))
    return functools.reduce(Column.bitwiseOR, [F.when(same(k), F.lit(1 << k)).otherwise(F.lit(0)) for k in places])


def _compared(hits: DataFrame) -> DataFrame:
    """(doc_id, mark, no, n_window, position, n_matched) of each hit: the most agreeing tokens in a window of the item whose
    first token is up to ``REACH`` before the seed. Beyond the item's ends no token agrees, so windows that lie across
    them have no more than the outermost inside. No lambda function takes part: it would end the generated loop, and all
    hits of a text would be put aside first, each with all of the text's words."""
    own, width = ["doc_id", "mark", "no", "n_window", "position"], F.least(F.lit(WINDOW), F.size("item"))
    at = hits.withColumns({"n_window": width, "position": F.col("at") - F.col("item_at")})
    half = at.select(*own, "w", "item", "here", "item_at", _one(_same(range(REACH)), "before"))
    same = half.select(*own, _one(F.col("before").bitwiseOR(_same(range(REACH, 2 * REACH + 1))), "same"))
    inside = same.select("*", _one(F.call_function("shiftleft", F.lit(1), F.col("n_window")) - 1, "inside"))
    counts = [F.bit_count(F.shiftright("same", k).bitwiseAND(F.col("inside"))) for k in range(REACH + 1)]
    return inside.select(*own, _one(F.greatest(*counts), "n_matched"))


def _sieve_bits(seed: Column) -> Column:
    """Up to four bits of a word."""
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(seed, by).bitwiseAND(F.lit(63)).cast("int"))
    return functools.reduce(Column.bitwiseOR, [bit(by) for by in (32, 38, 44, 50)])


def _sifted(sown: DataFrame, seeds: DataFrame, n_seeds: int) -> DataFrame:
    """``sown`` where the sieve passes the seed (all of ``seeds`` and few others), with the tokens around it only."""
    words = 1 << min(SIEVE_MOST.bit_length() - 1, max(SIEVE_ROW.bit_length(), math.ceil(n_seeds * SIEVE_WORDS).bit_length()))
    word = lambda seed: seed.bitwiseAND(F.lit(words - 1)).cast("int")
    none = seeds.sparkSession.range(words).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("bits"))
    bits = seeds.where(F.col("seed").isNotNull()).select(word(F.col("seed")).alias("i"), _sieve_bits(F.col("seed")).alias("bits")).unionByName(none)
    bits = bits.groupBy("i").agg(F.bit_or("bits").alias("bits"))
    listed = lambda by, what: F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]).alias(what)
    bits = bits.groupBy(F.expr(f"i div {SIEVE_ROW}").alias("row")).agg(listed("i", "bits")).agg(listed("row", "bits"))
    seed = F.col("seed")
    kept = F.get(F.get(bits.scalar(), F.shiftright(word(seed), SIEVE_ROW.bit_length() - 1)), word(seed).bitwiseAND(F.lit(SIEVE_ROW - 1)))
    passed = sown.where(F.bitwise_not(kept).bitwiseAND(_sieve_bits(seed)) == 0)
    first = F.greatest(F.lit(0), F.col("at") - REACH)
    around = F.slice("w", first + 1, F.lit(2 * REACH + 1))
    return checkpointed(passed.select("doc_id", "mark", around.alias("w"), "at", (F.col("at") - first).alias("here"), "seed"))


def _best(n_matched: Column, position: Column) -> Column:
    """A number that is the larger the more tokens agree, then the smaller the position is."""
    return n_matched.cast("long") * _MATCHED - position


def _found(docs: DataFrame, benchmark: DataFrame, seed_rows: int, item_chars: int) -> DataFrame:
    """(doc_id, mark, no, best, n_window): the best alignment of each text and item that overlap, see ``_best``;
    ``mark`` is a hash of the text, ``no`` an item of ``_items``."""
    items = _items(benchmark)
    seeds = _item_seeds(items)
    used = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # as many as there are masks at most
    chars = items.agg(F.sum(F.length(F.array_join("item", " ")))).first()[0] or 0
    n_seeds = seeds.count()
    passes = max(1, math.ceil(n_seeds / seed_rows), math.ceil(chars / item_chars))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), word_array(F.lower(F.col("text"))).alias("w"))
    least = min([1 + PATTERNS[k][-1] for k in used], default=SPAN)
    # No filter on the number of tokens: it would be moved below and split the text once more.
    places = F.when(F.size("w") >= least, F.sequence(F.lit(0), F.size("w") - least))
    placed = texts.select("doc_id", "mark", "w", F.explode(places).alias("at"))
    hashed = [_seed(F.col("w"), F.col("at"), k) for k in used] or [F.lit(None).cast("long")]
    sown = placed.select("doc_id", "mark", "w", "at", F.col("at").alias("here"), F.explode(F.array(*hashed)).alias("seed"))
    sown = _sifted(sown, seeds, n_seeds) if passes > 1 else sown
    found = None
    for k in range(passes):
        part = F.pmod(F.xxhash64("no", F.lit(5)), F.lit(passes)) == k
        own = seeds.where(part).select("no", "item_at", "seed")
        hits = sown.join(F.broadcast(own), "seed").join(F.broadcast(items.where(part)), "no")
        rows = _compared(hits).where(F.col("n_matched") >= F.ceil(F.col("n_window") * AGREE - 1e-9))
        one = rows.groupBy("doc_id", "mark", "no").agg(F.max(_best(F.col("n_matched"), F.col("position"))).alias("best"), F.max("n_window").alias("n_window"))
        one = checkpointed(one) if passes > 1 else one
        found = one if found is None else found.unionByName(one)
    return found, items


def overlaps(docs: DataFrame, benchmark: DataFrame, seed_rows: int = SEED_ROWS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, n_matched, n_window, position): for each document and item that overlap, the best
    aligned window's agreeing tokens, its length, and the text position of the item's (virtual) start."""
    found, items = _found(docs, benchmark, seed_rows, item_chars)
    ids = benchmark.where(F.col("item_id").isNotNull()).select("item_id", word_array(F.lower(F.col("text"))).alias("item")).distinct()
    ids = checkpointed(ids.join(items, "item").select("item_id", "no"))
    best = F.max(F.struct("best", "n_window"))
    one = found.join(small_side(ids), "no").groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
    n_matched = F.shiftright(F.col("best") + _MATCHED // 2, _MATCHED.bit_length() - 1)
    return one.select("doc_id", "item_id", n_matched.cast("int").alias("n_matched"), "n_window", (n_matched * _MATCHED - F.col("best")).cast("int").alias("position"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed_rows: int = SEED_ROWS, item_chars: int = ITEM_CHARS, most: int | None = None) -> DataFrame:
    """``docs`` without the rows that overlap with an item; a null doc_id saves no row."""
    found, _ = _found(docs, benchmark, seed_rows, item_chars)
    leaks = checkpointed(found.select(F.col("doc_id").alias(_ID), F.col("mark").alias(_MARK)).distinct())
    return docs.join(small_side(leaks, most), F.col("doc_id").eqNullSafe(F.col(_ID)) & (F.xxhash64("text") == F.col(_MARK)), "left_anti")
