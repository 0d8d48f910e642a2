"""Joins that need more than a key: bundles, containment, pairs, ranges, ladders of checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed, small_side


#: Keys of a place that meet in one block of pairs.
BLOCK = 2048
#: Rows of a task that makes pairs (four times as many pairs of one that counts them), and tasks at most.
TASK_ROWS, MOST_PARTS = 250_000, 20_000


def nest(rows: DataFrame, key: str, columns: Sequence[str], out: str) -> DataFrame:
    """One row for each key with its rows as a sorted array of structs."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(out))


def bundle(base: DataFrame, key: str, parts: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """``base`` with one array column for each part. Parts are nested before the joins, so that they don't multiply."""
    for name, (rows, columns) in parts.items():
        base = base.join(nest(rows, key, columns, name), key, "left")
    return base


def contained(arrays: DataFrame, array: str, element: str, rows: DataFrame) -> DataFrame:
    """Rows whose ``element`` is in an array, by an equi join on the exploded arrays."""
    return arrays.withColumn(element, F.explode(F.array_distinct(F.col(array)))).join(rows, element)


def any_of(rows: DataFrame, candidates: Sequence[Column], element: str, other: DataFrame) -> DataFrame:
    """Join where any of several columns (or arrays) of ``rows`` names the element, once each."""
    merged = candidates[0]
    for c in candidates[1:]:
        merged = F.array_union(merged, c)
    return rows.withColumn(element, F.explode(F.array_compact(F.array_distinct(merged)))).join(other, element)


def _pairs_of_lists(one: DataFrame, place: str, key: str, parts: int) -> DataFrame:
    """(place, a, b, ca, cb) of places of up to ``BLOCK`` rows, whose keys are a list each."""
    rows = one.repartition(parts, place).groupBy(place, key).agg(F.min("c").alias("c"))
    lists = rows.groupBy(place).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "c"))).alias("ks")).where(F.size("ks") > 1)
    firsts = lists.select(place, "ks", F.posexplode("ks").alias("i", "x"))
    pairs = firsts.select(place, "x", F.explode(F.slice("ks", F.col("i") + 2, F.lit(BLOCK))).alias("y"))
    return pairs.select(place, F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"))


def _pairs_of_blocks(one: DataFrame, place: str, key: str, parts: int) -> DataFrame:
    """The same of larger places: their keys are dealt in blocks, and blocks meet in pairs, so that a place is work for many tasks."""
    one = one.groupBy(place, key).agg(F.min("c").alias("c"))  # repeats go before pairs are made
    sized = one.join(one.groupBy(place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), place)
    own = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    dealt = sized.select(place, F.col(key).alias("k"), "c", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    left, right = (dealt.select(place, "low", "high", F.col("k").alias(k), F.col("c").alias(f"c{k}"), F.col("own").alias(f"own{k}")).repartition(parts, place, "low", "high") for k in ("a", "b"))
    met = left.join(right, [place, "low", "high"]).where((F.col("a") < F.col("b")) & ((F.col("low") == F.col("high")) | (F.col("owna") != F.col("ownb"))))
    return met.select(place, "a", "b", "ca", "cb")


def co_occurring(rows: DataFrame, place: str, key: str, confidence: str) -> DataFrame:
    """Unordered pairs of keys that share a place: first place, number of places, least confidence. Tasks get as many rows or
    pairs each whatever the size of the table: partitions are counted out, not merged by their compressed bytes."""
    one = rows.where(F.col(place).isNotNull() & F.col(key).isNotNull()).select(place, key, F.col(confidence).alias("c"))
    counts = one.groupBy(place).agg(F.count("*").alias("n"))
    n, most, pairs = counts.agg(F.sum("n"), F.max("n"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()
    parts, pair_parts = max(1, math.ceil((n or 0) / TASK_ROWS)), min(MOST_PARTS, max(1, math.ceil((pairs or 0) / (4 * TASK_ROWS))))
    if (most or 0) <= BLOCK:
        met = _pairs_of_lists(one, place, key, parts)
    else:
        large = small_side(checkpointed(counts.where(F.col("n") > BLOCK).select(place)))
        met = _pairs_of_lists(one.join(large, place, "left_anti"), place, key, parts).unionByName(_pairs_of_blocks(one.join(large, place, "left_semi"), place, key, parts))
    return met.repartition(pair_parts, "a", "b").groupBy("a", "b").agg(F.min(place).alias("first_place"), F.count("*").alias("n_places"), F.min(F.least("ca", "cb")).alias("confidence"))


def in_ranges(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, by: Sequence[str] = (), width: int = 1000) -> DataFrame:
    """Points in half-open ranges [low, high). Both are cut into cells of ``width``: an equi join on cells,
    with every range in each of its cells, in place of a comparison of all with all."""
    cell = F.floor(F.col(at) / width)
    cells = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
    left = points.withColumn("__cell", cell)
    right = ranges.where(F.col(high) > F.col(low)).withColumn("__cell", F.explode(cells))
    return left.join(right, [*by, "__cell"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def first_failure(checks: Sequence[tuple[str, Column]], passed: str = "OK") -> Column:
    """The name of the first check whose condition holds; ``passed`` if none does."""
    out = None
    for name, failed in checks:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise(passed)


def only_new(recent: DataFrame, baseline: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of the recent rows that the baseline hasn't."""
    return recent.select(*key).distinct().join(baseline.select(*key).distinct(), list(key), "left_anti")


def ambiguous(aliases: DataFrame, alias: str, canonical: str) -> DataFrame:
    """Aliases of more than one canonical name."""
    return aliases.groupBy(alias).agg(F.countDistinct(canonical).alias("n_canonical")).where("n_canonical > 1")


def close_pairs(words: DataFrame, word: str) -> DataFrame:
    """(a, b) of distinct words one edit apart, a < b. Two such words share a form with one character left out (or
    the word itself), so an equi join on those forms finds all candidates; the distance decides."""
    cut = F.expr("transform(sequence(1, length(w)), i -> concat(substring(w, 1, i - 1), substring(w, i + 1)))")
    distinct = words.select(F.col(word).alias("w")).where("length(w) > 0").distinct()
    forms = distinct.select("w", F.explode(F.array_distinct(F.concat(F.array("w"), cut))).alias("form"))
    left, right = forms.select(F.col("w").alias("a"), "form"), forms.select(F.col("w").alias("b"), "form")
    return left.join(right, "form").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b") <= 1)).select("a", "b").distinct()
