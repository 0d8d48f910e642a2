"""Rows laid out along a space-filling curve, and a bitmap index of what each file holds.

Each dimension's values become coordinates by their rank: of n rows, s have a smaller value, and the coordinate is
floor(bins * s / n). The coordinates' binary digits are interleaved to ``z``; rows in the order of (z, key) are cut into
files of ``per_file`` rows. The index answers boxes (coordinates at most ``reach`` away in each dimension) exactly:

* bounds: for each dimension and coordinate a bitset of the files whose bounds cover it; OR within the reach, AND across
  the dimensions, popcount;
* membership: for each cell a bitset of the files that hold a row of it; OR over the cells of the box, popcount.

Bitsets are cut into blocks of eight files, a byte each, and a block's bitsets are one array over all cells; blocks are
independent, and their counts are summed by cell. Ranks come from range-sorted tables of at most ``RANGES`` parts, so
what is broadcast or comes to the driver has a size fixed by parameters: a start for each part, ``bins`` thresholds for
each dimension, two counts for each of the ``bins ** dimensions`` cells.

Defined results: null values are the smallest, strings compare by their UTF-8 bytes; a null key comes first; rows that
are equal in (z, key) may swap places; repeated rows are rows of their own; no rows give no rows; columns that
aren't named are not read, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BINS, PER_FILE = 16, 1000
#: Most parts of a range-sorted table, and the rows of a part as long as there are fewer parts.
RANGES, PART_ROWS = 4096, 8192
#: Files of a block: the bits of a byte.
BLOCK = 8
#: Most cells: a block's bitsets take as many bytes, the broadcast counts 24 times as many.
MOST_CELLS = 1 << 20


def in_order(rows: DataFrame, n: int, order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """``rows`` (``n`` of them) with the sum of ``weight`` (rows, without one) over all rows before each in the
    ascending ``order``, nulls first. Equal rows are dealt over parts like any others."""
    tied = written(rows.withColumn("__tie", F.monotonically_increasing_id()), "ties")
    parts = min(RANGES, max(1, math.ceil(n / PART_ROWS)))
    by = [*order, "__tie"]
    dealt = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    # The upper bits of __at are the part, the lower ones the place in it; written, so that both stay as they are.
    dealt = written(dealt, "sorted").withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    own = F.count("*") if weight is None else F.sum(weight)
    totals = dealt.groupBy("__part").agg(own.alias("__sum"))
    # One task, for as many rows as there are parts: RANGES at most.
    starts = totals.select("__part", (F.sum("__sum").over(W.orderBy("__part")) - F.col("__sum")).alias("__start"))
    inside = F.col("__at")
    if weight is not None:
        inside = F.coalesce(F.sum(weight).over(W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("__inside", inside).join(F.broadcast(starts), "__part")
    return placed.select(*rows.columns, (F.col("__start") + F.col("__inside")).cast("long").alias(out))


def sort_key(value: Column, kind: str) -> Column:
    """A string in the order of ``value``: itself, or the 16 hex digits of a whole number with its sign bit turned."""
    if kind == "string":
        return value
    return F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def coordinates(rows: DataFrame, n: int, dimensions: list[str], bins: int = BINS) -> list[Column]:
    """Columns with the coordinate of each dimension (string or whole-number columns of ``rows``, a written table of
    ``n`` rows). Distinct values are counted first; ``bins`` thresholds for each dimension come to the driver."""
    kinds = dict(rows.dtypes)
    keys = [sort_key(F.col(d), kinds[d]) for d in dimensions]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), k.alias("k")) for i, k in enumerate(keys)]))
    counts = written(rows.select(each.alias("v")).select("v.d", "v.k").groupBy("d", "k").agg(F.count("*").alias("c")), "values")
    before = in_order(counts, counts.count(), ["d", "k"], "s", "c")
    firsts = before.select("d", "k", F.expr(f"((s - d * {n}L) * {bins}) div {n}L").alias("at"))  # each dimension has n rows
    found = firsts.groupBy("d", "at").agg(F.min("k").alias("k")).orderBy("d", "at").collect()
    out = []
    for i, key in enumerate(keys):
        column = F.lit(0)
        for r in found:  # ascending: the last threshold that isn't above the value holds
            if r.d == i and r.at and r.k is not None:
                column = F.when(key >= F.lit(r.k), F.lit(int(r["at"]))).otherwise(column)
        out.append(column.cast("int"))
    return out


def interleaved(coords: list[Column], bins: int = BINS) -> Column:
    """The coordinates' binary digits, the highest first, in turns."""
    digits, z = max(1, (bins - 1).bit_length()), F.lit(0).cast("long")
    for bit in reversed(range(digits)):
        for c in coords:
            z = z * 2 + F.shiftright(c, bit).bitwiseAND(1)
    return z


def _cells(z: np.ndarray, dimensions: int, digits: int) -> np.ndarray:
    """Row-major cell numbers of interleaved ones; the other way round with the same digits by ``_curve``."""
    out = np.zeros_like(z)
    for bit in range(digits):
        for d in range(dimensions):
            digit = (z >> (bit * dimensions + dimensions - 1 - d)) & 1
            out |= digit << ((dimensions - 1 - d) * digits + bit)
    return out


def _curve(cells: np.ndarray, dimensions: int, digits: int) -> np.ndarray:
    out = np.zeros_like(cells)
    for bit in range(digits):
        for d in range(dimensions):
            digit = (cells >> ((dimensions - 1 - d) * digits + bit)) & 1
            out |= digit << (bit * dimensions + dimensions - 1 - d)
    return out


def _spread(bits: np.ndarray, axis: int, reach: int) -> np.ndarray:
    """OR of the bitsets at most ``reach`` away along an axis."""
    out, at = bits.copy(), np.moveaxis(bits, axis, 0)
    to = np.moveaxis(out, axis, 0)
    for k in range(1, min(reach, at.shape[0] - 1) + 1):
        to[k:] |= at[:-k]
        to[:-k] |= at[k:]
    return out


def block_counts(pairs: pd.DataFrame, dimensions: int, bins: int, reach: tuple[int, ...]) -> pd.DataFrame:
    """(z, touched, matching) of one block: ``pairs`` has the distinct (file, z) of its files with the files' bounds.
    Cells whose box no file of the block meets are left out."""
    digits = max(1, (bins - 1).bit_length())
    side = 1 << digits
    files = pairs.drop_duplicates("file")
    bit = np.left_shift(1, files["file"].to_numpy() % BLOCK).astype(np.uint8)
    touched = np.full((side,) * dimensions, 0xFF, np.uint8)
    for d in range(dimensions):
        covers = np.zeros(side, np.uint8)
        for low, high, b in zip(files[f"low{d}"], files[f"high{d}"], bit, strict=True):
            covers[low : high + 1] |= b
        shape = [1] * dimensions
        shape[d] = side
        touched &= _spread(covers, 0, reach[d]).reshape(shape)
    members = np.zeros(side**dimensions, np.uint8)
    bits = np.left_shift(1, pairs["file"].to_numpy() % BLOCK).astype(np.uint8)
    np.bitwise_or.at(members, _cells(pairs["z"].to_numpy(), dimensions, digits), bits)
    members = members.reshape((side,) * dimensions)
    for d in range(dimensions):
        members = _spread(members, d, reach[d])
    t, m = np.bitwise_count(touched).ravel(), np.bitwise_count(members).ravel()
    at = np.flatnonzero(t)  # what matches is also touched
    return pd.DataFrame({"z": _curve(at.astype(np.int64), dimensions, digits), "touched": t[at].astype(np.int64), "matching": m[at].astype(np.int64)})


def lay_out(rows: DataFrame, key: str, dimensions: list[str], reach: tuple[int, ...], bins: int = BINS, per_file: int = PER_FILE) -> DataFrame:
    """(key, a coordinate ``c0``, ``c1``... for each dimension, z, position, file, bounds ``low0``, ``high0``..., files_touched,
    files_matching) for every row; the last two are of the box around the row's own cell."""
    count, digits = len(dimensions), max(1, (bins - 1).bit_length())
    if (cells := (1 << digits) ** count) > MOST_CELLS:
        raise ValueError(f"{cells} cells; {MOST_CELLS} at most")
    narrow = written(rows.select(key, *dimensions), "dimensions")
    n = narrow.count()
    coords = coordinates(narrow, n, dimensions, bins) if n else [F.lit(0) for _ in dimensions]
    names = [f"c{i}" for i in range(count)]
    located = narrow.select(key, *[c.alias(x) for c, x in zip(coords, names, strict=True)]).withColumn("z", interleaved([F.col(x) for x in names], bins))
    placed = in_order(located, n, ["z", key], "position").withColumn("file", F.expr(f"position div {per_file}L"))
    own = W.partitionBy("file")
    bounds = {f"{e}{i}": f(c).over(own) for i, c in enumerate(names) for e, f in (("low", F.min), ("high", F.max))}
    placed = written(placed.withColumns(bounds), "placed")
    pairs = placed.select(F.expr(f"file div {BLOCK}L").alias("block"), "file", "z", *bounds).distinct()

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        return block_counts(group, count, bins, reach)

    by_block = pairs.groupBy("block").applyInPandas(counted, "z long, touched long, matching long")
    by_cell = by_block.groupBy("z").agg(F.sum("touched").alias("files_touched"), F.sum("matching").alias("files_matching"))
    # A row for every cell, used or not: the broadcast has one size whatever the rows are.
    every = rows.sparkSession.range(cells).withColumnRenamed("id", "z").join(by_cell, "z", "left")
    return placed.join(F.broadcast(every), "z").select(key, *names, "z", "position", "file", *bounds, "files_touched", "files_matching")


def document_values(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, length, date) of ``docs`` (doc_id, source, lang, text): the length is that of the text in UTF-8
    bytes, -1 for a null; the date is the crc32 of the decimal id modulo 365, that of the empty text for a null id."""
    date = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 365).cast("long")
    length = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), length.alias("length"), date.alias("date"))


def document_layout(docs: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """The layout of documents by source, lang, length and date; a box takes in two coordinates of length and date either way."""
    return lay_out(document_values(docs), "doc_id", ["source", "lang", "length", "date"], (0, 0, 2, 2), per_file=per_file)
