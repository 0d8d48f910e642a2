"""Personal values of a corpus as reversible tokens: equal values share one over all texts, and keep it in later runs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import checkpointed, small_side

#: What a token looks like (fixed value); a text's own strings that look so are tokens' values, too, so that every text comes back.
TOKEN = r"\[[a-z0-9_]+_\d+\]"
#: Detectors by kind, the first kind wins where two overlap.
DETECTORS = (
    ("literal", re.compile(TOKEN)),
    ("email", re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")),
    ("phone", re.compile(r"\+\d[\d \-]{7,}\d")),
    ("number", re.compile(r"\d{6,}")),
)
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
_RESTORED = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([*_SPAN.fields, T.StructField("token", T.StringType())])))])


_ARROW_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
_ARROW_RESTORED = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([*_ARROW_SPAN, ("token", pa.string())])))])
#: Texts that are Python's objects at once.
PIECE = 64


def _in_pieces(run, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What ``run`` makes of the columns, in pieces: whole batches stay in Arrow's buffers."""
    pieces = [pa.array(run(*[x.slice(at, PIECE) for x in columns]), kind) for at in range(0, len(columns[0]), PIECE)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)


def spans_of(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    free, places = bytearray(len(text)), []
    for kind, pattern in DETECTORS:
        for m in pattern.finditer(text):
            if not any(free[m.start() : m.end()]):
                free[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                places.append((m.start(), m.end(), kind, m[0]))
    found.extend(sorted(places))
    return found


@F.arrow_udf(T.ArrayType(_SPAN))
def personal_spans(texts: pa.Array) -> pa.Array:
    return _in_pieces(lambda piece: [[dict(zip(_SPAN.names, s, strict=True)) for s in spans_of(x or "")] for x in piece.to_pylist()], pa.list_(_ARROW_SPAN), texts)


def _agree(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    match = F.lit(True)
    for c in names:
        match = match & a[c].eqNullSafe(b[f"__{c}"])
    return match


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in names})


def numbered(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(corpus, kind, value, number, token): each distinct value of ``values`` (corpus, kind, value) has a number of its own, dense from 1
    within (corpus, kind); those of ``known``, an earlier result, stay as they are, and new values follow.

    New values are numbered in two levels: ranges of their digests have starts, and ranks are counted inside a range, so no corpus meets in
    one task. A null corpus is a corpus of its own; null values have no number."""
    keys = ["corpus", "kind", "value"]
    new = values.select(*keys).where(F.col("value").isNotNull()).distinct()
    if known is not None:
        other = _renamed(known.select(*keys), keys)
        new = new.join(other, _agree(new, other, keys), "left_anti")
    new = checkpointed(new.withColumn("__digest", F.md5("value")).withColumn("__range", F.substring("__digest", 1, 3)))
    counts = new.groupBy("corpus", "kind", "__range").agg(F.count("*").alias("__n"))
    before = W.partitionBy("corpus", "kind").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # 4,096 rows a corpus and kind at most
    if known is not None:
        most = _renamed(known.groupBy("corpus", "kind").agg(F.max("number").alias("__most")), ["corpus", "kind"])
        starts = starts.join(most, _agree(starts, most, ["corpus", "kind"]), "left").drop("__corpus", "__kind")
        starts = starts.withColumn("__start", F.col("__start") + F.coalesce("__most", F.lit(0))).drop("__most")
    side = _renamed(starts, ["corpus", "kind", "__range"])
    own = F.row_number().over(W.partitionBy("corpus", "kind", "__range").orderBy("__digest", "value"))
    ranked = new.withColumn("__own", own)
    out = ranked.join(side, _agree(ranked, side, ["corpus", "kind", "__range"])).withColumn("number", (F.col("__start") + F.col("__own")).cast("long"))
    out = out.select(*keys, "number", F.concat(F.lit("["), F.col("kind"), F.lit("_"), F.col("number"), F.lit("]")).alias("token"))
    return out if known is None else known.select(*keys, "number", "token").unionByName(out)


def _rows(docs: DataFrame, key: str, text: str, corpus: str, each: Column) -> DataFrame:
    """A row for each element of ``each``; rows of equal key, corpus and text are one document."""
    named = docs.select(F.col(key).alias("key"), F.col(corpus).alias("corpus"), F.xxhash64(text).alias("text_hash"), F.explode(each).alias("x"))
    return named.distinct()


def _back(docs: DataFrame, key: str, text: str, corpus: str, lists: DataFrame, out: str) -> DataFrame:
    """``docs`` with each document's list."""
    side = lists.withColumnsRenamed({"key": "__key", "corpus": "__corpus", "text_hash": "__text_hash"})
    match = docs[key].eqNullSafe(side["__key"]) & docs[corpus].eqNullSafe(side["__corpus"]) & (F.xxhash64(docs[text]) == side["__text_hash"])
    return docs.join(side, match, "left").drop("__key", "__corpus", "__text_hash").withColumnRenamed("__list", out)


def depersonalise(docs: DataFrame, key: str, text: str, corpus: str, known: DataFrame | None = None, spans=personal_spans) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``encoded`` and ``tokens`` (their number), the tokens of the corpus for a next run and for ``restored``). ``spans`` maps a text column to
    an array of (start, end, kind, value) in order, without overlaps. Only spans are joined; texts meet their own list of tokens once."""
    found = checkpointed(_rows(docs, key, text, corpus, spans(F.col(text))).select("key", "corpus", "text_hash", "x.*"))
    tokens = checkpointed(numbered(found, known))
    side = small_side(_renamed(tokens.select("corpus", "kind", "value", "token"), ["corpus", "kind", "value"]))
    placed = found.join(side, _agree(found, side, ["corpus", "kind", "value"])).groupBy("key", "corpus", "text_hash")
    lists = placed.agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("__list"))
    rows = _back(docs, key, text, corpus, lists, "__spans")
    x, s = F.coalesce(F.col(text), F.lit("")), F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int,token:string>>"))
    end_before = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
    pieces = F.transform(s, lambda p, i: F.concat(F.substr(x, end_before(i) + 1, p["start"] - end_before(i)), p["token"]))
    tail = F.substr(x, end_before(F.size(s)) + 1, F.length(x))
    encoded = F.concat(F.array_join(pieces, ""), tail)
    return rows.withColumn("encoded", F.when(F.col(text).isNotNull(), encoded)).withColumn("tokens", F.size(s)).drop("__spans"), tokens


def _restored_rows(texts: pa.Array, values: pa.Array) -> list[dict]:
    rows = []
    for text, pairs in zip(texts.to_pylist(), values.to_pylist(), strict=True):
        own, out, size, at, spans = {p["token"]: p for p in pairs or []}, [], 0, 0, []
        for m in re.finditer(TOKEN, text or ""):
            if p := own.get(m[0]):
                out += [text[at : m.start()], p["value"]]
                size += m.start() - at
                spans.append({"start": size, "end": size + len(p["value"]), "kind": p["kind"], "value": p["value"], "token": m[0]})
                size, at = size + len(p["value"]), m.end()
        rows.append({"text": None if text is None else "".join([*out, text[at:]]), "spans": spans})
    return rows


@F.arrow_udf(_RESTORED)
def _put_back(texts: pa.Array, values: pa.Array) -> pa.Array:
    return _in_pieces(_restored_rows, _ARROW_RESTORED, texts, values)


def restored(docs: DataFrame, key: str, text: str, corpus: str, tokens: DataFrame, allowed: Column | None = None) -> DataFrame:
    """``docs`` with ``restored`` (text, and the spans that were put back: start, end, kind, value, token). Only known tokens of the own corpus, and of
    these only ``allowed`` ones (an array of tokens; null or none given: all; empty: none), turn back into their values."""
    seen = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), 0))
    if allowed is not None:
        seen = F.when(allowed.isNull(), seen).otherwise(F.array_intersect(seen, F.transform(allowed, lambda x: F.trim(x))))
    found = _rows(docs, key, text, corpus, seen).withColumnRenamed("x", "token")
    side = small_side(_renamed(tokens.select("corpus", "token", "kind", "value"), ["corpus", "token"]))
    lists = found.join(side, _agree(found, side, ["corpus", "token"])).groupBy("key", "corpus", "text_hash").agg(F.collect_list(F.struct("token", "kind", "value")).alias("__list"))
    rows = _back(docs, key, text, corpus, lists, "__values")
    return rows.withColumn("restored", _put_back(F.col(text), F.col("__values"))).drop("__values")
