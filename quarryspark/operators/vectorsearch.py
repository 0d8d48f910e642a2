"""Exact filtered vector search, block by block.

Points pass by in blocks; a block is multiplied with all queries of its filter key as matrices, and only the k best of each query
are kept, so there is never a row for a pair of point and query. What is shuffled are k rows for each query and task. Queries
go to the tasks as one broadcast matrix if their measured bytes are within a bound; beyond it, blocks of queries meet blocks of
points, each block of bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES, checkpointed

#: Points that are multiplied at once, rows of a block of points and of queries where queries aren't broadcast, and digits
#: of a score that are told apart.
AT_ONCE, POINT_BLOCK, QUERY_BLOCK, DIGITS = 2048, 65_536, 4096, 6
_BEST = "__q long, __id long, __score double"


def _units(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with ``__v``, the vector as doubles of length one; those that are null, zero, empty, or hold null or non-finite components go."""
    x = F.transform(vector, lambda v: v.cast("double"))
    rows = vectors.withColumn("__x", x).withColumn("__n", F.sqrt(F.aggregate("__x", F.lit(0.0), lambda s, v: s + v * v)))
    sound = F.col("__n").isNotNull() & ~F.isnan("__n") & (F.col("__n") > 0) & (F.col("__n") < float("inf"))
    return rows.where(sound).withColumn("__v", F.transform("__x", lambda v: v / F.col("__n"))).drop("__x", "__n")


def _keyed(vectors: DataFrame, vector: str, by: Sequence[str], key: str, out: str) -> DataFrame:
    """(out, __key, __v): what has to agree are the filter columns, none null, and the number of components."""
    rows = _units(vectors, vector)
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    parts = F.to_json(F.struct(F.size("__v").alias("n"), *[F.col(c) for c in by]))
    return rows.select(F.col(key).cast("long").alias(out), parts.alias("__key"), "__v")


class Best:
    """The k best points of each query so far, by score and then the smaller id."""

    def __init__(self, queries: pd.DataFrame, k: int):
        self.k, self.ids = k, queries["__q"].to_numpy()
        self.at = {key: np.asarray(places) for key, places in queries.groupby("__key", sort=False).indices.items()}
        self.matrix = {key: np.stack([np.asarray(v, dtype=np.float64) for v in queries["__v"].iloc[places]]).T for key, places in self.at.items()}
        self.score = np.full((k, len(queries)), -np.inf)
        self.point = np.full((k, len(queries)), np.iinfo(np.int64).max)

    def add(self, points: pd.DataFrame) -> None:
        for key, places in points.groupby("__key", sort=False).indices.items():
            if key in self.at:
                for start in range(0, len(places), AT_ONCE):
                    some = points.iloc[places[start : start + AT_ONCE]].sort_values("__id")
                    self._add(key, some["__id"].to_numpy(), np.stack([np.asarray(v, dtype=np.float64) for v in some["__v"]]))

    def _add(self, key: str, ids: np.ndarray, matrix: np.ndarray) -> None:
        queries, k = self.at[key], min(self.k, len(ids))
        scores = matrix @ self.matrix[key]
        scores[ids[:, None] == self.ids[queries][None, :]] = -np.inf
        shown = np.round(scores, DIGITS)
        least = np.partition(shown, len(ids) - k, axis=0)[len(ids) - k]
        above, equal = shown > least, shown == least
        # Ids ascend: of equal scores the first ones fill what the better ones have left.
        kept = above | (equal & (np.cumsum(equal, axis=0) <= k - above.sum(0)))
        column, row = np.nonzero(kept.T)
        score = np.concatenate([self.score[:, queries], scores[row, column].reshape(-1, k).T])
        point = np.concatenate([self.point[:, queries], ids[row].reshape(-1, k).T])
        order = np.lexsort((point, -np.round(score, DIGITS)), axis=0)[: self.k]
        self.score[:, queries], self.point[:, queries] = np.take_along_axis(score, order, 0), np.take_along_axis(point, order, 0)

    def rows(self) -> pd.DataFrame:
        found = self.score > -np.inf
        _, column = np.nonzero(found)
        return pd.DataFrame({"__q": self.ids[column], "__id": self.point[found], "__score": self.score[found]})


def top_k(points: DataFrame, queries: DataFrame, k: int, by: Sequence[str] = (), vector: str = "v", query_vector: str = "q", key: str = "vec_id", query_key: str = "query_id", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_key, key, score, rank): the ``k`` points of the largest cosine for each query among those that agree in ``by``, but
    for the one of the query's own id; scores are told apart to six digits, ties go to the smaller id.

    Keys are whole numbers, and unique. Vectors that are null, zero, empty, or hold null or non-finite components take no part, a null filter
    value agrees with none, and vectors of different lengths aren't compared. Queries with fewer points have fewer rows."""
    p, q = _keyed(points, vector, by, key, "__id"), _keyed(queries, query_vector, by, query_key, "__q")
    size = q.agg(F.sum(F.lit(8) * F.size("__v") + F.octet_length("__key") + 16 + 16 * k).alias("bytes"), F.count("*").alias("n")).first()
    if (size["bytes"] or 0) <= most_bytes:
        sent = points.sparkSession.sparkContext.broadcast(q.toPandas())  # measured above

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = Best(sent.value, k)
            for batch in batches:
                best.add(batch)
            yield best.rows()

        near = p.mapInPandas(run, _BEST)
    else:
        deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        m, blocks = math.ceil(size["n"] / QUERY_BLOCK), math.ceil(max(1, p.count()) / POINT_BLOCK)
        left = p.select("__id", "__key", "__v", deal("__id", blocks).alias("__pb"), every(m).alias("__qb")).groupBy("__pb", "__qb")
        right = q.select("__q", "__key", "__v", deal("__q", m).alias("__qb"), every(blocks).alias("__pb")).groupBy("__pb", "__qb")

        def meet(some_points: pd.DataFrame, some_queries: pd.DataFrame) -> pd.DataFrame:
            best = Best(some_queries, k)
            best.add(some_points)
            return best.rows()

        near = left.cogroup(right).applyInPandas(meet, _BEST)
    score = F.round("__score", DIGITS)
    ranked = near.select(F.col("__q").alias(query_key), F.col("__id").alias(key), score.alias("score"))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def soft_top_k(points: DataFrame, queries: DataFrame, k: int, by: Sequence[str], query_key: str = "query_id", **other) -> DataFrame:
    """``top_k`` under the filter; queries that it leaves without any hit, and only these, are searched again without it."""
    strict = checkpointed(top_k(points, queries, k, by, query_key=query_key, **other))
    unanswered = queries.join(strict.select(query_key).distinct(), query_key, "left_anti")
    return strict.unionByName(top_k(points, unanswered, k, query_key=query_key, **other))
