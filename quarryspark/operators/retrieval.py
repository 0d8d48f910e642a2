"""Retrieval: filtered vector search, hybrid ranking, hydration, context, citations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the hybrid score, and the knowledge score of chunks without one (fixed values).
VECTOR, KNOWLEDGE, NO_SCORE = 0.75, 0.25, 0.5


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hybrid_rank(hits: DataFrame, knowledge: DataFrame, key: str, score: str = "score", knowledge_score: str = "knowledge_score", query_key: str = "query_id") -> DataFrame:
    """Hits reranked by the weighted sum of vector and knowledge score; a missing or zero score counts as one half."""
    known = F.coalesce(F.nullif(F.col(knowledge_score), F.lit(0.0)), F.lit(NO_SCORE))
    rows = hits.join(knowledge, key, "left").withColumn("hybrid", F.round(VECTOR * F.col(score) + KNOWLEDGE * known, 8))
    w = W.partitionBy(query_key).orderBy(F.desc("hybrid"), key)
    return rows.withColumn("rank", F.row_number().over(w))


def hydrate(hits: DataFrame, chunks: DataFrame, key: str, fallbacks: dict[str, Column]) -> DataFrame:
    """Hits with their chunks' columns; where a chunk is gone, the fallbacks."""
    return hits.join(chunks, key, "left").select(*hits.columns, *[F.coalesce(F.col(c), d).alias(c) for c, d in fallbacks.items()])


def citations(blocks: DataFrame, query_key: str, rank: str, source: str) -> DataFrame:
    return blocks.withColumns({"citation_id": F.format_string("c%d-%d", F.col(query_key), F.col(rank)), "download_url": F.concat(F.lit("/api/kb/items/"), F.col(source), F.lit("/download"))})


def grounding(ready: Column, n_hits: Column, best: Column, least: float) -> Column:
    return F.when(~ready, "BLOCKED_NOT_READY").when((n_hits == 0) | best.isNull() | (best < least), "NO_ANSWER").otherwise("ANSWERED")


def packet_floor(packets: DataFrame, by: str, score: str, floor: float = 0.35, share: float = 0.8) -> DataFrame:
    """Packets at or above the larger of a fixed floor and a share of the group's best."""
    return packets.withColumn("floor", F.greatest(F.lit(floor), share * F.max(score).over(W.partitionBy(by)))).where(F.col(score) >= F.col("floor"))


def sources(hits: DataFrame, by: str, key: Sequence[str], rank: str, k: int = 8) -> DataFrame:
    """The first hit of each source, at most ``k``."""
    first = hits.withColumn("__n", F.row_number().over(W.partitionBy(by, *key).orderBy(rank))).where("__n = 1").drop("__n")
    return first.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy(rank))).where(F.col("position") <= k)


def blocking_reasons(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in checks.items()]))


def nearness(a: Column, b: Column, metric: str) -> Column:
    """Inner product, cosine or Euclidean distance of two vectors, in double precision."""
    dot = inner_product
    if metric == "dot":
        return dot(a, b)
    if metric == "euclid":
        gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def merged_packets(lists: Sequence[DataFrame], by: str, kind: str, score: str, key: str, caps: dict[str, int], cap: int) -> DataFrame:
    """Lists of packets as one, those at or above their group's floor, at most so many of each kind, best first."""
    rows = packet_floor(reduce(lambda a, b: a.unionByName(b), lists), by, score)
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(kind)), F.lit(cap)) if caps else F.lit(cap)
    w = W.partitionBy(by, kind).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
