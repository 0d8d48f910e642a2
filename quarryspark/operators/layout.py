"""Page layout: words to lines and blocks, lines repeated at page edges, table headers carried on."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Distance of a word's top from its line's first word, gap between blocks, margin of page edges, and what counts as
#: a banner when it stands twice only (fixed values).
LINE_TOP, BLOCK_GAP, EDGE_MARGIN = 3.0, 14.0, 42.0
BANNER_CHARS, BANNER_WORDS = 52, 9
HEADER_CELL_CHARS = 40


def word_blocks(words: DataFrame, page: str, top: str, bottom: str, left: str, text: str) -> DataFrame:
    """(page, block, line, text): words in reading order, a new line where the top is further than ``LINE_TOP`` from
    that of the line's first word, a new block where the gap to the line before is over ``BLOCK_GAP``. A line begins
    where the last one ended, so a task walks through its pages' sorted words, and holds one line at a time."""
    kind = words.schema[page].dataType.simpleString()

    def run(batches):
        now: tuple | None = None  # the page that is walked through
        line: list[str] = []
        first = upper = lower = before = 0.0
        block = number = 0
        out: list[tuple] = []

        def ended() -> None:
            nonlocal block, number, before, line
            if line:
                block += number > 0 and upper - before > BLOCK_GAP
                out.append((now[0], block, number, " ".join(line)))
                number, before, line = number + 1, lower, []

        def taken(schema: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            kinds = (schema, pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[page, "block", "line", "text"])

        for batch in batches:
            pages, *others = (batch.column(k).to_pylist() for k in range(4))
            for p, t, b, x in zip(pages, *others, strict=True):
                if now is None or p != now[0]:
                    ended()
                    now, block, number = (p,), 0, 0
                elif line and abs(t - first) > LINE_TOP:
                    ended()
                if not line:
                    first = upper = t
                    lower = b
                upper, lower = min(upper, t), max(lower, b)
                line.append(x or "")
            own = batch.schema.field(0).type
            yield taken(own)
        if line:
            ended()
            yield taken(own)

    number = lambda name: F.col(name).cast("double").alias(name)
    rows = words.select(page, number(top), number(bottom), text, F.col(left).cast("double").alias("__left"), (F.rint(F.col(top).cast("double") * 10) / 10).alias("__near"))
    sorted_ = rows.where(F.col(top).isNotNull() & F.col(bottom).isNotNull()).repartition(page).sortWithinPartitions(page, "__near", "__left", text)
    return sorted_.select(page, top, bottom, text).mapInArrow(run, f"{page} {kind}, block int, line int, text string")


def repeated_edge_lines(lines: DataFrame, by: Sequence[str], text: str, top: str, bottom: str, height: str) -> DataFrame:
    """(by, key, n_times): normalised lines that stand three times, or twice if they look like a banner, and always
    near the top or bottom edge of their page."""
    key = F.lower(F.btrim(F.regexp_replace(F.col(text), r"\s+", " ")))
    near = (F.col(top) <= EDGE_MARGIN) | (F.col(height) - F.col(bottom) <= EDGE_MARGIN)
    rows = lines.select(*by, key.alias("key"), near.alias("near")).where(F.length("key") >= 3)
    seen = rows.groupBy(*by, "key").agg(F.count("*").alias("n_times"), F.bool_and("near").alias("near"))
    words = F.regexp_count("key", F.lit(r"[\p{L}\p{N}_]+"))
    banner = (F.length("key") <= BANNER_CHARS) & (words <= BANNER_WORDS)
    return seen.where(F.col("near") & ((F.col("n_times") >= 3) | ((F.col("n_times") >= 2) & banner))).drop("near")


def looks_like_header(cells: Column) -> Column:
    """Two short cells at least, few of which have digits."""
    full = F.filter(F.transform(cells, lambda x: F.btrim(x)), lambda x: x != "")
    digits = F.size(F.filter(full, lambda x: x.rlike(r"\d")))
    return (F.size(full) >= 2) & F.forall(full, lambda x: F.length(x) <= HEADER_CELL_CHARS) & (digits <= F.greatest(F.lit(1), F.floor(F.size(full) / 3)))


def carried_headers(rows: DataFrame, by: Sequence[str], order: str, is_row: Column, cells: str) -> DataFrame:
    """``rows`` with table_role (header, row, unknown; null outside tables) and headers: in each run of table rows
    the first that looks like a header gives its cells to those after it."""
    w = W.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("__row", F.coalesce(is_row, F.lit(False)))
    marked = marked.withColumn("__run", F.sum(F.when(F.col("__row"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*by, "__run", "__row").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    header = F.first(F.when(F.col("__row") & looks_like_header(F.col(cells)), F.struct(F.col(order).alias("o"), F.col(cells).alias("c"))), ignorenulls=True).over(inside)
    out = marked.withColumn("__h", header)
    filled = F.exists(cells, lambda x: F.btrim(x) != "")
    role = F.when(~F.col("__row"), None).when(F.col("__h.o") == F.col(order), "header").when(F.coalesce(filled, F.lit(False)), "row").otherwise("unknown")
    return out.withColumns({"table_role": role, "headers": F.when(F.col("__row"), F.col("__h.c"))}).drop("__row", "__run", "__h")
