"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its seeded-shuffled documents, as often repeated as its target may need. A
document's virtual finish time is the number of its source's words up to and with it, divided by the source's target
(its weight's share of the budget, after water-filling): each source passes time 1 just when its target is reached. So
in the global order of virtual time any beginning has the wanted mixture, and time 1 is where the total budget
is used up: there the order is cut. A document is taken whole if its middle is passed by then, else left; each
source's words are therefore within half a document of its target.

Running sums never put a source into one task: words are summed for each of many hash ranges of each source (more
of them for more rows), the ranges' sums are accumulated, and exact places are found within a range. Rows of
equal source, id and size are one item with a number until then.

Defined results: a null text has no words; sources sort by code point, null last, as a source of its own;
documents without words are taken with zero words, target or not; repeated rows are rows of their own, each with
its own place; ties of the shuffle go by id and size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, hex_digits, numbered, quoted, small_side, spelled_out

#: Weights of the sources in order, repeating; budget as a share of all words; most repeats of a document.
WEIGHTS, BUDGET, REPEATS = (5, 2, 1), 1.5, 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str, *more: Column) -> Column:
    """A seeded order that SQL engines agree on; a null id counts as the empty text."""
    parts = [F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))]
    for x in more:
        parts += [F.lit(":"), x.cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def _numbers(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the place of each source from 0 in ``k``: sorted ranges, each numbered on its own."""
    ranged = checkpointed(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()))
    counts = ranged.groupBy("p").agg(F.count("*").alias("c"))  # a row for each partition: the window without a key is small
    starts = counts.select("p", (F.sum("c").over(W.orderBy("p")) - F.col("c")).alias("start"))
    own = F.row_number().over(W.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("k", own).join(F.broadcast(starts), "p").withColumn("k", F.col("k") + F.col("start")).drop("p", "start")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of ``budget`` x all words by weight,
    none above ``repeats`` x its source; what is cut off is shared again, until none is above: the level of the
    uncapped rises from round to round, each an aggregate of two sums, until no more sources are capped."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    rows = _numbers(sizes).withColumn("weight", weight).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    rows = checkpointed(rows.withColumn("ratio", F.col("cap") / F.col("weight")).select("source", "source_size", "weight", "cap", "ratio"))
    whole = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = 0.0, -1
    while True:
        over = F.col("ratio") < F.lit(level)
        s = rows.where(over).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if s[0] == capped:
            break
        capped = s[0]
        rest = (whole[1] or 0.0) - (s[2] or 0.0)
        if rest <= 0:
            level = float("inf")
            break
        level = (budget * (whole[0] or 0) - (s[1] or 0.0)) / rest
    return rows.select("source", "source_size", F.when(F.col("ratio") < F.lit(level), F.col("cap")).otherwise(F.least("cap", F.lit(level) * F.col("weight"))).alias("target"))


def virtual_times(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, before, finish) of each row: ``before`` is the number of the source's
    words ahead in its queue, ``finish`` the virtual finish time of the first copy."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    items = checkpointed(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("key", shuffle_key(F.col("doc_id"), seed)))
    items = items.withColumn("range", F.substring("key", 1, hex_digits(items.count())))
    by_range = checkpointed(items.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("range_size")))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = by_range.select("source", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("start"))
    aims = checkpointed(targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, budget, repeats))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = items.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    both = starts.alias("s").join(small_side(aims).alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select("s.source", "s.range", "s.start", "a.source_size", "a.target")
    out = placed.alias("p").join(both.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.range") == F.col("b.range")))
    out = out.select("p.doc_id", "p.source", "p.size", "p.n", "b.source_size", "b.target", (F.col("p.inside") + F.col("b.start")).alias("first"))
    each = spelled_out(checkpointed(out), "n", "copy").withColumn("before", F.col("first") + F.col("copy") * F.col("size"))
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    return each.select("doc_id", "source", "size", "source_size", "target", "before", finish.alias("finish"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, finish), range-sorted by virtual finish time; ``taken`` is
    the document's words times the copies of it whose middle is passed at virtual time 1, where the order is cut."""
    rows = virtual_times(docs, weights, budget, repeats, seed)
    half = F.col("size") / F.lit(2.0)
    copies = F.lit(0)
    for copy in range(repeats):
        middle = F.col("finish") + (F.lit(copy) * F.col("source_size") - half) / F.col("target")
        copies = copies + F.when((F.col("target") > 0) & (middle <= 1.0), 1).otherwise(0)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), "finish")
    return rows.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = SEED, most: int | None = None) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: as many whole copies of each document, as rows of their own,
    as the mixture takes. A document without words is kept once."""
    copies = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.expr("taken div size"))
    plan = mix(docs, weights, budget, repeats, seed).select("doc_id", "source", "size", copies.alias("copies"))
    # Rows of equal source, id and size: how many of them stand for how many copies.
    keys = ["__mix_id", "__mix_source", "__mix_size"]
    kinds = plan.groupBy("doc_id", "source", "size", "copies").agg(F.count("*").alias("c")).select(F.col("doc_id").alias(keys[0]), F.col("source").alias(keys[1]), F.col("size").alias(keys[2]), F.col("copies").alias("__mix_copies"), F.col("c").alias("__mix_rows"))
    kinds = checkpointed(kinds)
    mixed = kinds.groupBy(*keys).agg(F.count("*").alias("k"), F.max("__mix_copies").alias("__mix_copies"))
    plain, uneven = checkpointed(mixed.where("k = 1 and __mix_copies > 0").drop("k")), checkpointed(mixed.where("k > 1").select(*keys))
    sized = docs.withColumns({"__mix_own_size": n_words(F.col("text")), "__mix_own_source": F.col("source").cast("string")})
    same = F.col("doc_id").eqNullSafe(F.col(keys[0])) & F.col("__mix_own_source").eqNullSafe(F.col(keys[1])) & (F.col("__mix_own_size") == F.col(keys[2]))
    out = sized.join(small_side(plain, most), same).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__mix_copies"))).select(*quoted(docs.columns))
    if not uneven.limit(1).count():
        return out
    # Repeated rows on both sides of the cut: numbered, the first of them stand for the most copies.
    rows = numbered(sized.join(small_side(uneven, most), same), keys, "__mix_n")
    order = W.partitionBy(*keys).orderBy(F.desc("__mix_copies"))
    spans = kinds.withColumn("__mix_last", F.sum("__mix_rows").over(order)).withColumn("__mix_first", F.col("__mix_last") - F.col("__mix_rows") + 1)
    spans = spans.select(*[F.col(c).alias(f"{c}_") for c in keys], "__mix_copies", "__mix_first", "__mix_last")
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"{c}_"))
    met = rows.join(spans, match & F.col("__mix_n").between(F.col("__mix_first"), F.col("__mix_last"))).where("__mix_copies > 0")
    more = met.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__mix_copies"))).select(*quoted(docs.columns))
    return out.unionByName(more)
