"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in a seeded order; sorted by fractional rank, (rank - 1/2) / rows of
the source, every stretch of the whole has the sources' shares; the sorted rows are cut into shards whose
row counts differ by one at most. Ranks are counted in two levels (ranges of each source's order, then of the
fractional rank; the more rows, the more ranges), and equal rows are one item with a number until they are ranked:
no source, no id and no table ever meets in one task.

Defined results: a null text has size 1 and the crc32 of the empty text; a null source is a source of its
own, and a null id counts as the empty text in the order; repeated rows are rows of their own, and
identical rows may swap places; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import RANGE_ROWS, checkpointed, hex_digits, numbered, quoted, small_side, spelled_out, written
from .mixing import shuffle_key

SHARDS, SEED = 8, "shard-1"
#: Ranges of the fractional rank at least; more for more than so many times ``RANGE_ROWS``.
RANGES = 4096
_KIND = ["doc_id", "size", "text_crc32"]


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _rows(docs: DataFrame) -> DataFrame:
    text = _bytes(F.col("text"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, source, text)."""
    columns = ["source", "doc_id", "size", "text_crc32"]
    items = _rows(docs).groupBy(*columns).agg(F.count("*").alias("n"))
    items = checkpointed(items.withColumn("key", shuffle_key(F.col("doc_id"), seed, F.col("text_crc32"))))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    items = items.withColumn("range", F.substring("key", 1, hex_digits(total)))
    by_range = items.groupBy("source", "range").agg(F.sum("n").alias("rows"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = by_range.select("source", "range", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start"), F.sum("rows").over(W.partitionBy("source")).alias("source_rows"))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = items.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("p").join(starts.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.range") == F.col("s.range")))
    placed = checkpointed(placed.select(*[F.col(f"p.{c}").alias(c) for c in (*columns, "key", "n")], (F.col("s.start") + F.col("p.inside")).alias("first"), "s.source_rows"))
    each = spelled_out(placed, "n", "copy")
    ranges = max(RANGES, total // RANGE_ROWS)
    share = (F.col("first") + F.col("copy") + F.lit(0.5)) / F.col("source_rows")
    ranked = checkpointed(each.select(*columns, "key", share.alias("share"), F.floor(share * ranges).alias("part")))
    # As many rows as ranges: the only window without a key, and a broadcast of known size.
    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))
    within = F.row_number().over(W.partitionBy("part").orderBy("share", "source", "key", "doc_id", "text_crc32", "size")) - 1
    out = ranked.withColumn("within", within).join(F.broadcast(offsets), "part").withColumn("at", F.col("offset") + F.col("within"))
    shard = F.expr(f"(at * {shards}) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return out.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).cast("long").alias("slot"))


def _located(docs: DataFrame) -> DataFrame:
    """``docs`` with a file and a row number that name each row, from the files it is read from; what isn't read from
    files is written to some first."""
    try:
        return docs.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    except AnalysisException:
        return written(docs, "rows").withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def _same(names: list[str], ends: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}{ends}"))
    return out


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, most: int | None = None) -> DataFrame:
    """``docs`` with shard (int) and slot (long); rows of equal id and text get the places of their kind one each. Only
    narrow rows are sorted and joined; the places come to the texts by file and row number."""
    located = _located(docs)
    places = checkpointed(assign(docs, shards, seed).drop("source"))
    kinds = places.groupBy(*_KIND).agg(F.count("*").alias("n"), F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    kinds = checkpointed(kinds.select(*[F.col(c).alias(f"{c}_") for c in _KIND], "n", "shard", "slot"))
    text = _bytes(F.col("text"))
    rows = located.select("__file", "__row", "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    repeated = kinds.where("n > 1").drop("n", "shard", "slot")
    if repeated.limit(1).count():
        rows, side = checkpointed(rows), small_side(repeated, most)
        own = numbered(rows.join(side, _same(_KIND, "_"), "left_semi"), _KIND, "nth")
        free = numbered(places.join(side, _same(_KIND, "_"), "left_semi"), _KIND, "nth")
        free = free.select(*[F.col(c).alias(f"{c}_") for c in (*_KIND, "nth")], "shard", "slot")
        several = own.join(free, _same([*_KIND, "nth"], "_")).select("__file", "__row", "shard", "slot")
    else:
        several = None
    found = rows.join(small_side(kinds.where("n = 1"), most), _same(_KIND, "_")).select("__file", "__row", "shard", "slot")
    found = checkpointed(found.unionByName(several) if several is not None else found)
    found = found.select(F.col("__file").alias("__file_"), F.col("__row").alias("__row_"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    done = located.join(small_side(found, most), _same(["__file", "__row"], "_"))
    return done.select(*quoted(docs.columns), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
