"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of equal size (grown along edges, then
refined by moves to the part of most neighbours, within the capacity). A small neural classifier learns the parts; its
biases are shifted until it deals the sample evenly, and every vector is indexed in the part it names. A second one
learns in which of these parts a vector's neighbours are: a query goes to its several most probable parts and
is reranked there by the exact inner product. There are about a quarter of a square root of the vectors as many parts,
up to what the sample can teach; how many are probed is calibrated on sampled queries, for a wanted recall, and a
query whose parts hold too few vectors goes to more of them.

Equal vectors are one node, with their smallest ids (no more of them than a result holds can ever be in
one), so copies don't fill a part. Parts and their queries are joined block by block of bounded size.

Defined results: vectors that are null, zero, hold null or non-finite components, have no id, or haven't the
most frequent length (of equally frequent ones, the smallest) take no part, as candidates or queries; ties
go to the smaller id; fewer candidates than asked for are all returned; repeated rows of an id and vector count
once; the nearness of ids with several vectors is their largest one, and each id is in a result once; an empty
table gives no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Vectors of the sample that parts and classifier are fitted on, at most (about; a hash threshold picks them).
SAMPLE_ROWS = 8192
GRAPH_NEIGHBOURS, HIDDEN, EPOCHS = 16, 64, 12
#: Vectors of the sample to a part at least, and the fullest part against the mean after balancing.
PART_SAMPLE, FULLEST = 32, 1.2
#: Recall on sampled queries that the number of probed parts is calibrated for.
WANTED_RECALL = 0.95
#: Vectors and queries that meet in one task.
BLOCK, QUERY_BLOCK = 4096, 4096


def parts_for(vectors: int, sample_rows: int = SAMPLE_ROWS) -> int:
    """A power of two near a quarter of the square root of the vectors, as far as the sample goes."""
    return max(1, min(2 ** max(2, round(math.log2(max(vectors, 1)) / 2 - 2)), min(vectors, sample_rows) // PART_SAMPLE))


class Classifier:
    """One hidden layer and a softmax over the parts; sees directions only."""

    def __init__(self, dimension: int, parts: int):
        r = np.random.default_rng(7)
        self.weights = [r.normal(0, dimension**-0.5, (dimension, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(_unit(x) @ w1 + b1, 0) @ w2 + b2

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")

    def learn(self, x: np.ndarray, aim: np.ndarray) -> None:
        """Adam on the cross entropy with the wanted shares of the parts."""
        unit, r, step = _unit(x), np.random.default_rng(8), 0
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        w = self.weights
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                z = np.maximum(unit[rows] @ w[0] + w[1], 0)
                out = z @ w[2] + w[3]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                g = (out / out.sum(axis=1, keepdims=True) - aim[rows]) / len(rows)
                gz = (g @ w[2].T) * (z > 0)
                step += 1
                for i, grad in enumerate((unit[rows].T @ gz, gz.sum(axis=0), z.T @ g, g.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * grad
                    second[i] = 0.999 * second[i] + 0.001 * grad**2
                    w[i] -= 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def balance(self, x: np.ndarray, rounds: int = 400) -> None:
        """Shifts the biases until no part is named for much more than its share; keeps the most even ones."""
        free = self.logits(x) - self.weights[3]
        bias, best, mean = self.weights[3].copy(), (np.inf, self.weights[3]), len(x) / free.shape[1]
        for k in range(rounds):
            filled = np.bincount((free + bias).argmax(axis=1), minlength=free.shape[1])
            if filled.max() < best[0]:
                best = (filled.max(), bias.copy())
            if filled.max() <= FULLEST * mean:
                break
            bias -= 0.3 / (1 + k / 50) * np.log((filled + 1) / (mean + 1))
        self.weights[3] = best[1]


@dataclass
class Router:
    """Where vectors are indexed, where queries go, and to how many parts."""

    index: Classifier
    query: Classifier
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k): for each vector, those of the largest inner products, in blocks; without itself."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), dtype=np.int64)
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0), dtype=np.int64)
        out[at : at + 512] = top
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part for each node, none with over ``slack`` times its share, with few edges between parts."""
    n = len(graph)
    edges: list[set[int]] = [set(r) for r in graph.tolist()]
    for a, row in enumerate(graph.tolist()):
        for b in row:
            edges[b].add(a)
    part, size = np.full(n, -1, dtype=np.int64), -(-n // parts)
    start = 0
    for p in range(parts):  # grow each part along its strongest edges
        gain: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        for _ in range(size):
            node = -1
            while heap:
                g, v = heapq.heappop(heap)
                if part[v] < 0 and gain.get(v) == -g:
                    node = v
                    break
            if node < 0:
                while start < n and part[start] >= 0:
                    start += 1
                if start == n:
                    break
                node = start
            part[node] = p
            for v in edges[node]:
                if part[v] < 0:
                    gain[v] = gain.get(v, 0) + 1
                    heapq.heappush(heap, (-gain[v], v))
    most, filled = int(slack * n / parts) + 1, np.bincount(part, minlength=parts)
    lists = [np.fromiter(e, dtype=np.int64, count=len(e)) for e in edges]
    for _ in range(rounds):
        moved = 0
        for v in range(n):
            if len(lists[v]):
                counts = np.bincount(part[lists[v]], minlength=parts)
                counts[(filled >= most) & (np.arange(parts) != part[v])] = -1
                to = int(counts.argmax())
                if counts[to] > counts[part[v]]:
                    filled[part[v]] -= 1
                    filled[to] += 1
                    part[v] = to
                    moved += 1
        if not moved:
            break
    return part


def fit(x: np.ndarray, k: int, parts: int, wanted: float = WANTED_RECALL, share: float = 1.0) -> Router | None:
    """Graph, balanced parts, classifiers and calibrated probes, from a sample of vectors, which is ``share`` of all;
    None for a single part."""
    x = np.asarray(x, dtype=np.float64)
    n = len(x)
    parts = max(1, min(parts, n // PART_SAMPLE))
    if parts == 1:
        return None
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS)

    def shares(part: np.ndarray) -> np.ndarray:
        aim = np.zeros((n, parts))
        np.add.at(aim, (np.arange(n)[:, None], part[graph]), 1.0)
        return aim / np.maximum(aim.sum(axis=1, keepdims=True), 1.0)

    part = balanced_parts(graph, parts)
    index, query = Classifier(x.shape[1], parts), Classifier(x.shape[1], parts)
    own = shares(part) * GRAPH_NEIGHBOURS
    own[np.arange(n), part] += 4.0  # where a vector's neighbours are, and itself
    index.learn(x, own / own.sum(axis=1, keepdims=True))
    index.balance(x)
    where = index.order(x)[:, 0]
    query.learn(x, shares(where))
    # The nearest of all vectors are as near as the nearest few of the sample.
    probe = np.random.default_rng(9).permutation(n)[: min(n, 2048)]
    near = neighbour_graph_of(x, probe, max(1, math.ceil(k * share)))
    rank = np.empty((len(probe), parts), dtype=np.int64)
    np.put_along_axis(rank, query.order(x[probe]), np.arange(parts)[None, :], axis=1)
    reached = np.sort(np.take_along_axis(rank, where[near], axis=1).ravel())
    return Router(index, query, int(reached[min(len(reached) - 1, int(wanted * len(reached)))]) + 1)


def neighbour_graph_of(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The graph's rows of some nodes only."""
    s = x[rows] @ x.T
    s[np.arange(len(rows)), rows] = -np.inf
    k = min(k, len(x) - 1)
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 1))


def _meet(k: int):
    """The ``k`` best ids of a block for each query node of a block."""

    def best(score: np.ndarray, nodes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        m = min(k, len(score))
        while True:
            edge = np.partition(score, len(score) - m)[len(score) - m]
            at = np.flatnonzero(score >= edge)  # all that tie with the last
            ids = np.concatenate([nodes[i] for i in at])
            s = np.repeat(score[at], [len(nodes[i]) for i in at])
            order = np.lexsort((ids, -s))
            ids, s = ids[order], s[order]
            first = np.sort(np.unique(ids, return_index=True)[1])  # an id with several vectors counts with its best
            if len(first) >= k or m == len(score):
                return ids[first[:k]], s[first[:k]]
            m = min(2 * m, len(score))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        node, ids, scores = [], [], []
        if len(left) and len(right):
            v, own = _matrix(right["v"]), right["ids"].tolist()
            for at in range(0, len(left), 512):
                rows = left.iloc[at : at + 512]
                for q, s in zip(rows["query_node"].to_numpy(), _matrix(rows["v"]) @ v.T, strict=True):
                    i, x = best(s, own)
                    node.append(np.full(len(i), q))
                    ids.append(i)
                    scores.append(x)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, dtype=kind)
        return pd.DataFrame({"query_node": join(node, "int64"), "vec_id": join(ids, "int64"), "score": join(scores, "float64")})

    return run


def search(table: DataFrame, is_query: Column, k: int = 20, parts: int | None = None, sample_rows: int = SAMPLE_ROWS, wanted: float = WANTED_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``table`` (vec_id, embedding)
    for which ``is_query`` (an expression of vec_id) holds, among all rows but itself."""
    rows = usable(table)
    # Equal vectors become a node, with the k + 1 smallest ids (a query may be one).
    first = rows.distinct().withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    grouped = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = checkpointed(grouped.select(F.monotonically_increasing_id().alias("node"), "ids", "v"))
    total = nodes.count()
    share = 1.0 if total <= sample_rows else sample_rows / total
    picked = nodes.where(F.pmod(F.xxhash64("v", F.lit(11)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    sample = picked.select(F.get("ids", F.lit(0)).alias("id"), "v").toPandas().sort_values("id", kind="stable")
    router = fit(_matrix(sample["v"]), k, parts or parts_for(total, sample_rows), wanted, share) if len(sample) > 1 else None

    @F.pandas_udf("int")
    def part_of(v: pd.Series) -> pd.Series:
        return pd.Series(router.index.order(_matrix(v))[:, 0] if router and len(v) else np.zeros(len(v)), dtype="int32")

    index = checkpointed(nodes.select("node", "ids", "v", part_of("v").alias("part")))
    # At most a number for each part: how many vectors it has.
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}

    @F.pandas_udf("array<int>")
    def probed(v: pd.Series) -> pd.Series:
        if not router or not len(v):
            return pd.Series([[0]] * len(v))
        order = router.query.order(_matrix(v))
        held = np.cumsum(np.array([sizes.get(p, 0) for p in range(order.shape[1])])[order], axis=1)
        upto = np.maximum(router.probes, (held <= k).sum(axis=1) + 1)  # parts with k other nodes at least, or all
        return pd.Series([row[:n].astype(np.int32) for row, n in zip(order, upto, strict=True)])

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = checkpointed(asked.join(nodes.select("v", "node"), "v").select("query_id", F.col("node").alias("query_node")))
    queries = asked.select(F.col("query_node").alias("node")).distinct().join(nodes.select("node", "v"), "node")
    routed = checkpointed(queries.select(F.col("node").alias("query_node"), "v", F.explode(probed("v")).alias("part")))
    # How many blocks a part and its queries have.
    blocks = {p: -(-n // BLOCK) for p, n in sizes.items()}
    query_blocks = {r["part"]: -(-r["count"] // QUERY_BLOCK) for r in routed.groupBy("part").count().collect()}
    number = lambda of: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in sorted(of) for x in (p, of[p])]), F.col("part")), F.lit(0)) if of else F.lit(0)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.greatest(n, F.lit(1))).cast("int")
    left = routed.withColumn("qb", own("query_node", number(query_blocks))).withColumn("vb", F.explode(upto(number(blocks))))
    right = index.withColumn("vb", own("node", number(blocks))).withColumn("qb", F.explode(upto(number(query_blocks))))
    keys = ("part", "vb", "qb")
    kind = dict(table.dtypes)["vec_id"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meet(k + 1), f"query_node long, vec_id {kind}, score double")
    # Parts are disjoint by nodes, not by ids: an id of several vectors may be there once for each.
    ids = met.groupBy("query_node", "vec_id").agg(F.max("score").alias("score"))
    ids = ids.withColumn("n", F.row_number().over(W.partitionBy("query_node").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    got = asked.join(ids, "query_node").where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    got = got.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return got.select("query_id", "rank", "vec_id", "score")
