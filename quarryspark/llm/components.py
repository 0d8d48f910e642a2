"""Connected components of an edge list, by alternating large-star and small-star rounds.

Each round points every node at the smallest node it sees (first among its larger neighbours, then among
its smaller ones); the edge list turns into stars in a number of rounds that grows with the logarithm of
the nodes. A hub's edges never meet in one row or list: minima are partial aggregates, and the join back
to the edges is an ordinary equi join, whose skewed partitions Spark splits. Edges that are counted to be few are
settled by one task instead, with the same result: rounds of shuffles cost more than they are worth there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, small_side, written


#: Distinct edges up to which one task settles them (some 100 MB there).
FEW = 300_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct()


def _settled(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges, by union and find in one task."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches):
        up: dict = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        columns = [pa.array(x, batch.schema.field("src").type) for x in (nodes, [find(n) for n in nodes])] if nodes else []
        if columns:
            yield pa.RecordBatch.from_arrays(columns, names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, rounds: int = 100, few: int = FEW) -> DataFrame:
    """(node, root): for each node of an edge list (src, dst), the smallest node that it is connected with.
    Loops and repeated edges do no harm; an empty list gives no rows."""
    edges = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    if edges.count() <= few:
        return _settled(edges)
    state = None
    for _ in range(rounds):
        edges = checkpointed(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(edges.select("dst", "dst").distinct())


#: The temporary columns of ``first_rows``.
_ID, _MARK = "__near_id", "__near_mark"


def first_rows(docs: DataFrame, rows: DataFrame, most: int | None = None) -> DataFrame:
    """``docs`` with one row of each component. ``rows`` has (doc_id, mark, root) of every row of ``docs``; ``mark`` is
    xxhash64 of its text. The row of the smallest id stays (null after all others), of several texts of that id
    the one of the smallest hash, of rows that repeat both any one."""
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")
    rows = rows.select("root", place.alias("at"))
    several = checkpointed(rows.groupBy("root").agg(F.count("*").alias("m"), F.min("at").alias("low")).where("m > 1").select("root", "low"))
    inside = written(rows.join(small_side(several, most), "root").groupBy("at", "low").agg(F.count("*").alias("m")), "copies")
    named = lambda x: x.select(F.col("at.doc_id").alias(_ID), F.col("at.mark").alias(_MARK))
    drop, repeated = checkpointed(named(inside.where("at <> low")).distinct()), checkpointed(named(inside.where("at = low and m > 1")))
    same = F.col("doc_id").eqNullSafe(F.col(_ID)) & (F.xxhash64("text") == F.col(_MARK))
    kept = docs.join(small_side(drop, most), same, "left_anti")
    if not repeated.limit(1).count():
        return kept
    side = small_side(repeated, most)
    again = kept.join(side, same, "left_semi").withColumn(_MARK, F.xxhash64("text")).dropDuplicates(["doc_id", _MARK]).select(*quoted(docs.columns))
    return kept.join(side, same, "left_anti").unionByName(again)
