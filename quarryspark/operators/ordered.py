"""Order-dependent operators: latest rows, pages, trailing windows, budgets, folds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Old and new rows, the newest of each key."""
    return latest(old.unionByName(new), key, [F.desc(version)])


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows numbered in order within each group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def keyset_page(rows: DataFrame, ts: str, key: str, cursor: tuple[str, int] | None, size: int) -> DataFrame:
    """A page of the newest rows before a cursor, and whether there is one after it: one row more is read."""
    if cursor:
        at, last = F.lit(cursor[0]).cast(rows.schema[ts].dataType), F.lit(cursor[1])
        rows = rows.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < last)))
    head = rows.orderBy(F.desc(ts), F.desc(key)).limit(size + 1)  # size + 1 rows, so the window below is small
    w = W.orderBy(F.desc(ts), F.desc(key))
    return head.withColumns({"position": F.row_number().over(w), "has_next": F.count("*").over(W.partitionBy()) > size}).where(F.col("position") <= size)


def cursor_text(ts: Column, key: Column) -> Column:
    """A cursor as base64 of JSON."""
    return F.base64(F.to_json(F.struct(ts.cast("string").alias("ts"), key.alias("id"))).cast("binary"))


def trailing_count(rows: DataFrame, by: Sequence[str], ts: str, seconds: int, out: str = "n_trailing") -> DataFrame:
    """Rows of the group in the ``seconds`` up to and with each row."""
    w = W.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn(out, F.count("*").over(w))


def fixed_window_limit(rows: DataFrame, by: Sequence[str], ts: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Numbers the rows of each fixed window; those within ``limit`` are allowed."""
    slot = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)
    w = W.partitionBy(*by, "slot").orderBy(ts, order)
    return rows.withColumn("slot", slot).withColumn("n", F.row_number().over(w)).withColumn("allowed", F.col("n") <= limit)


def reserve(rows: DataFrame, by: Sequence[str], order: Sequence[str], quota: int | Column) -> DataFrame:
    """Unit reservations against a quota, in order."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).withColumn("allowed", F.col("n") <= quota)


def suffix_within(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """The newest rows whose sizes fit into a budget: all before the first (from the end) that doesn't. As the
    running sum never falls, a row fits exactly if the sum from it to the end does."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def previous_value(rows: DataFrame, by: Sequence[str], order: str, when: Column, value: str, out: str) -> DataFrame:
    """The last value before each row among those for which a condition holds."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(when, F.col(value)), ignorenulls=True).over(w))


def context_blocks(hits: DataFrame, by: Sequence[str], rank: str, text: str, key: str, blocks: int = 6, budget: int = 4000, least: int = 120) -> DataFrame:
    """The first hit of each key, at most ``blocks``; texts are cut to what is left of the budget, though never
    below ``least`` characters, so later blocks still get a little when it is used up."""
    first = latest(hits, [*by, key], [F.col(rank)])
    w = W.partitionBy(*by).orderBy(rank)
    kept = first.withColumn("block", F.row_number().over(w)).where(F.col("block") <= blocks)
    used = F.collect_list(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, -1))  # at most ``blocks`` numbers
    spent = F.aggregate(used, F.lit(0), lambda acc, n: acc + F.least(n, F.greatest(F.lit(least), F.lit(budget) - acc)))
    room = F.greatest(F.lit(least), F.lit(budget) - spent)
    return kept.withColumn("used", F.least(F.length(text), room)).withColumn("context", F.substring(F.col(text), F.lit(1), F.col("used")))


def pack_blocks(blocks: DataFrame, by: str, order: str, text: str, kind: str, most: int = 1800, short: int = 200) -> DataFrame:
    """(by, chunk, texts, kinds, length): blocks packed greedily into chunks in order. Headings and tables begin
    a chunk, tables stand alone, and a chunk isn't filled over ``most`` characters; then a chunk shorter than
    ``short`` joins the one before it, if both fit and neither is a table. A block without a kind stands alone, a null
    text is an empty one. A walk over sorted partitions that holds two chunks."""
    own = blocks.schema[by].dataType.simpleString()

    def run(batches):
        now, out, number = None, [], 0
        last = chunk = None  # [texts, kinds, length] of the chunk before, and of the one that is filled; tables come first

        def closed() -> None:
            nonlocal last, chunk, number
            if last and chunk and "table" not in (last[1][0], chunk[1][0]) and chunk[2] < short and last[2] + chunk[2] <= most:
                last = [x + y for x, y in zip(last, chunk, strict=True)]
            else:
                if last:
                    out.append((now[0], number, *last))
                    number += 1
                last = chunk
            chunk = None

        def ended() -> None:
            nonlocal number
            closed()
            closed()
            number = 0

        def taken(group: pa.DataType) -> pa.RecordBatch:
            kinds = (group, pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32())
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[by, "chunk", "texts", "kinds", "length"])

        for batch in batches:
            for group, t, k in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if now is None or group != now[0]:
                    ended()
                    now = (group,)
                alone = k in (None, "title", "heading", "table") or (chunk and chunk[1][0] in (None, "table"))
                if chunk and (alone or chunk[2] + len(t) > most):
                    closed()
                chunk = chunk or [[], [], 0]
                chunk[0].append(t)
                chunk[1].append(k)
                chunk[2] += len(t)
            yield taken(batch.schema.field(0).type)
        if chunk or last:
            ended()
            yield taken(batch.schema.field(0).type)

    rows = blocks.select(by, order, F.coalesce(F.col(text), F.lit("")).alias(text), kind).repartition(by).sortWithinPartitions(by, order, text, kind)
    return rows.select(by, text, kind).mapInArrow(run, f"{by} {own}, chunk int, texts array<string>, kinds array<string>, length int")


def without_overlaps(spans: DataFrame, by: Sequence[str], start: str, end: str, priority: Sequence[Column]) -> DataFrame:
    """Spans kept greedily in order of priority, none overlapping a kept one; those without both ends, or ending before
    they start, are left out. A walk over sorted partitions that holds the kept spans of the group at hand."""
    names, keys = [f"__p{k}" for k in range(len(priority))], len(by)
    kinds = [spans.schema[name].dataType.simpleString() for name in by]

    def run(batches):
        now, starts, ends = None, [], []  # of the kept: disjoint, so in one order
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            groups = columns[0] if keys == 1 else list(zip(*columns[:keys], strict=True)) if keys else [()] * batch.num_rows
            chosen = []
            for row, (group, s, e) in enumerate(zip(groups, columns[keys], columns[keys + 1], strict=True)):
                if group != now:
                    now, starts, ends = group, [], []
                at = bisect_left(starts, e)  # those that start before this one ends
                if at == 0 or ends[at - 1] <= s:
                    starts.insert(at, s)
                    ends.insert(at, e)
                    chosen.append(row)
            yield batch.take(pa.array(chosen, pa.int64()))

    rows = spans.where(F.col(start) <= F.col(end)).select(*by, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end), *[p.alias(n) for p, n in zip(priority, names, strict=True)])
    ordered = rows.repartition(*by).sortWithinPartitions(*by, *names, start, end).select(*by, start, end)
    return ordered.mapInArrow(run, ", ".join([*[f"`{n}` {k}" for n, k in zip(by, kinds, strict=True)], f"`{start}` long", f"`{end}` long"]))


def admitted(items: DataFrame, by: str, order: str, size: str, limit: int) -> DataFrame:
    """Items in order; one that would exceed the limit is flagged, and doesn't count for the next. A walk over sorted
    partitions that keeps one sum for the group at hand, so groups of any size pass in batches."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def run(batches):
        at, total = object(), 0
        for pdf in batches:
            fits = []
            for group, n in zip(pdf[by], pdf[size], strict=True):
                group = None if pd.isna(group) else group
                if group != at:
                    at, total = group, 0
                fits.append(bool(total + n <= limit))
                total += n if fits[-1] else 0
            yield pdf.assign(fits=fits)

    rows = items.select(by, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size)).repartition(by).sortWithinPartitions(by, order, size)
    return rows.mapInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, {size} long, fits boolean")


def heading_paths(lines: DataFrame, by: str, order: str, level: str, title: str, levels: int = 6) -> DataFrame:
    """For each line the stack of headings above it: a heading drops those of its own and deeper levels. The newest
    heading of each level counts if no higher one came after it: a window for each level, no list."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    newest = [F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(title).alias("t"))), ignorenulls=True).over(w).alias(f"__{k}") for k in range(1, levels + 1)]
    rows = lines.select(by, order, *newest)
    held = []
    for k in range(1, levels + 1):
        above = [F.col(f"__{j}.o") for j in range(1, k)]
        last = F.greatest(*above) if len(above) > 1 else above[0] if above else None
        fits = F.col(f"__{k}").isNotNull() if last is None else F.col(f"__{k}").isNotNull() & (last.isNull() | (F.col(f"__{k}.o") > last))
        held.append(F.when(fits, F.col(f"__{k}.t")))
    return rows.select(by, order, F.array_compact(F.array(*held)).alias("path"))


def retry_state(attempts: Column, failed_at: Column, delay_seconds: int, most: int) -> tuple[Column, Column]:
    """Status after a failure, and when to retry: the delay grows with the attempts; at ``most``, it is dead."""
    status = F.when(attempts >= most, "dead_letter").otherwise("retry")
    due = F.when(attempts < most, (F.unix_seconds(failed_at.cast("timestamp")) + delay_seconds * attempts))
    return status, due
