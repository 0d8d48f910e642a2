"""Recognition results: languages, terms, topics, entities, edges, scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Second over best score from which a text counts as mixed; weights of the knowledge score (fixed values).
MIXED = 0.7
WEIGHTS = {"language_confidence": 0.08, "freshness_score": 0.06, "structure_score": 0.10, "entity_density_score": 0.10, "keyword_quality_score": 0.12, "topic_coverage_score": 0.10, "temporal_score": 0.08, "spatial_score": 0.08, "process_score": 0.08, "relationship_score": 0.10, "content_type_score": 0.10, "source_quality_score": 0.10}


def detect_language(docs: DataFrame, key: str, tokens: Column, markers: dict[str, Sequence[str]], hint: Column | None = None) -> DataFrame:
    """(key, language, confidence) by the share of distinct tokens that are marker words of a language: the
    best, "mixed" if the second is close, "unknown" without any. Row by row, without a join."""
    words = F.array_distinct(tokens)
    scores = []
    for code, own in markers.items():
        share = F.size(F.array_intersect(F.col("__w"), F.array(*[F.lit(w) for w in own]))) / F.greatest(F.size("__w"), F.lit(1))
        if hint is not None:
            share = F.when(F.array_contains(hint, code), F.least(F.lit(1.0), share + 0.05)).otherwise(share)
        scores.append(F.struct((-F.bround(share, 4)).alias("s"), F.lit(code).alias("code")))
    ranked = docs.select(key, words.alias("__w")).select(key, F.array_sort(F.array(*scores)).alias("r"))
    best, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    mixed = (second["s"] < 0) & (-second["s"] >= -best["s"] * MIXED)
    language = F.when(best["s"] == 0, "unknown").when(mixed, "mixed").otherwise(best["code"])
    confidence = F.when(best["s"] == 0, 0.0).when(mixed, F.bround(-(best["s"] + second["s"]) / 2, 4)).otherwise(-best["s"])
    return ranked.select(key, language.alias("language"), confidence.alias("confidence"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not anew for each element of a lambda in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """Array of (token, frequency) by token, from an array of tokens: sorted, and cut into runs, within the row."""
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("frequency")))
    counted = _once(F.sort_array(tokens), lambda s: _once(begins(s), lambda at: run(s, at)))
    return F.when(F.size(tokens) > 0, counted)


def _counted(docs: DataFrame, key: str, tokens: Column, stopwords: Sequence[str]) -> DataFrame:
    # Columns of their own, or the tokens would be looked for again at each use.
    kept = F.filter(tokens, lambda x: ~x.isin(*stopwords)) if stopwords else tokens
    return docs.select(key, kept.alias("__t")).select(key, F.size("__t").alias("__n"), term_counts(F.col("__t")).alias("__c"))


def term_frequency(docs: DataFrame, key: str, tokens: Column, stopwords: Sequence[str]) -> DataFrame:
    """(key, token, frequency, tf) of a row's tokens (an array) that aren't stop words. Nothing is shuffled; rows of
    the same key are counted apart."""
    # Of a slice: from a plain column Spark would infer a filter on its size, and compute all of it a second time.
    rows = _counted(docs, key, tokens, stopwords).select(key, "__n", F.explode(F.slice("__c", 1, (1 << 31) - 1)).alias("x"))
    return rows.select(key, "x.token", "x.frequency", (F.col("x.frequency") / F.col("__n")).alias("tf"))


def top_terms(docs: DataFrame, key: str, tokens: Column, stopwords: Sequence[str], k: int) -> DataFrame:
    """(key, token, rank, frequency): a row's ``k`` most frequent tokens, ties by token."""
    order = F.transform("__c", lambda x: F.struct((-x["frequency"]).alias("less"), x["token"].alias("token")))
    best = _counted(docs, key, tokens, stopwords).select(key, F.posexplode(F.slice(F.sort_array(order), 1, k)).alias("at", "x"))
    return best.select(key, "x.token", (F.col("at") + 1).alias("rank"), (-F.col("x.less")).alias("frequency"))


def match_topics(docs: DataFrame, key: str, tokens: Column, topics: dict[str, tuple[Sequence[str], float]], boosts: DataFrame | None = None) -> DataFrame:
    """(key, topic, hits, confidence): a row's distinct markers of each topic found, weighted."""
    found = [F.struct(F.lit(name).alias("topic"), F.size(F.array_intersect("__t", F.array(*[F.lit(m) for m in markers]))).cast("long").alias("hits"), F.lit(float(weight)).alias("weight")) for name, (markers, weight) in topics.items()]
    rows = docs.select(key, F.array_distinct(tokens).alias("__t")).select(key, F.explode(F.filter(F.array(*found), lambda x: x["hits"] > 0)).alias("x"))
    hits, boost = rows.select(key, "x.*"), F.lit(0.0)
    if boosts is not None:
        hits, boost = hits.join(boosts, [key, "topic"], "left"), F.coalesce("boost", F.lit(0.0))
    return hits.select(key, "topic", "hits", F.least(F.lit(1.0), (0.45 + 0.12 * F.col("hits")) * F.col("weight") + boost).alias("confidence"))


def match_topic_rules(docs: DataFrame, key: str, text: Column, keywords: Column, topics: dict[str, Sequence[str]]) -> DataFrame:
    """(key, topic, hits): markers that are anywhere in a normalised text, parts of words included, and once more those that are among its keywords
    (an array; case doesn't matter). Null texts and null keywords have no hits; topics without hits have no row."""
    words = F.transform(F.coalesce("__k", F.array().cast("array<string>")), F.lower)
    whole = F.coalesce("__x", F.lit(""))
    found = []
    for topic, markers in topics.items():
        inside = sum((F.contains(whole, F.lit(m)).cast("long") for m in markers), F.lit(0))
        listed = sum((F.array_contains("__k", m.lower()).cast("long") for m in markers), F.lit(0))
        found.append(F.struct(F.lit(topic).alias("topic"), (inside + listed).cast("long").alias("hits")))
    rows = docs.select(key, text.alias("__x"), keywords.alias("__k")).withColumn("__k", words)
    return rows.select(key, F.explode(F.filter(F.array(*found), lambda x: x["hits"] > 0)).alias("x")).select(key, "x.*")


def best_candidates(rows: DataFrame, key: Sequence[str], confidence: str, order: str) -> DataFrame:
    """The surest candidate of each key; the first of equals."""
    w = W.partitionBy(*key).orderBy(F.desc(confidence), order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_entities(rows: DataFrame, key: Sequence[str], confidence: str, chunk: str) -> DataFrame:
    """Most confidence and the sorted set of chunks of each entity."""
    pairs = rows.groupBy(*key, chunk).agg(F.max(confidence).alias("__c"))  # repeats go before lists are made
    return pairs.groupBy(*key).agg(F.max("__c").alias("confidence"), F.array_sort(F.collect_list(chunk)).alias("chunks"))


def edge_union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def warnings(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in checks.items()])), ",")


def structure_score(has_title: Column, chunk_type: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 + F.when(has_title, 0.3).otherwise(0.0) + F.when(chunk_type.isin("table", "list", "step", "faq"), 0.3).otherwise(0.0))


def knowledge_score(*, language_confidence, structure_score, entities, keywords, topics, temporal, spatial, processes, relationship_score, content_type, source_type) -> Column:
    """Weighted sum of twelve components between 0 and 1; freshness is constant."""
    share = lambda n, full: F.least(F.lit(1.0), n / F.lit(float(full)))
    some = lambda n: F.when(n > 0, 1.0).otherwise(0.0)
    parts = {
        "language_confidence": F.bround(language_confidence, 4),
        "freshness_score": F.lit(1.0),
        "structure_score": structure_score,
        "entity_density_score": share(entities, 5),
        "keyword_quality_score": share(keywords, 10),
        "topic_coverage_score": F.least(F.lit(1.0), 0.3 * topics),
        "temporal_score": some(temporal),
        "spatial_score": some(spatial),
        "process_score": share(processes, 3),
        "relationship_score": F.bround(relationship_score, 4),
        "content_type_score": F.when(content_type.isin("unknown", "general_text"), 0.4).otherwise(0.8),
        "source_quality_score": F.when(source_type.isin("pdf", "docx", "url"), 0.8).otherwise(0.6),
    }
    total = reduce(lambda a, b: a + b, [F.lit(WEIGHTS[k]) * v for k, v in parts.items()])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def profile_confidence(content: Column, language: Column, keywords: Column, topics: Column, boost: Column) -> Column:
    """Confidence of an enrichment profile: a base with boosts for what was found, between 0 and 1."""
    base = 0.4 * content + 0.3 * language + F.when(keywords > 0, 0.15).otherwise(0.0) + F.when(topics > 0, 0.15).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + boost)), 4)


def rule_rows(measures: Sequence[DataFrame], rules: Sequence[tuple[str, str, str | None, float | None, str, tuple[str, float] | None]]) -> DataFrame:
    """(rule, priority, value, threshold, status) from frames of one row each with the measures. A rule has a measure, a
    threshold, how it triggers ("least": from the threshold on, "most": below it, "over": above it, "any": above zero), and
    maybe a second measure with the least that it needs; it is unavailable without a measure."""
    whole = reduce(lambda a, b: a.join(b, "__k"), [m.withColumn("__k", F.lit(1)) for m in measures])  # one row each

    def row(rule, priority, measure, threshold, how, also):
        value, bound = (F.col(measure).cast("double") if measure else F.lit(None).cast("double")), F.lit(threshold).cast("double")
        hit = {"least": value >= bound, "most": value < bound, "over": value > bound, "any": value > 0}[how]
        hit = hit & (F.col(also[0]) >= also[1]) if also else hit
        status = F.when(value.isNull(), "unavailable").when(hit, "triggered").otherwise("ok")
        return F.struct(F.lit(rule).alias("rule"), F.lit(priority).alias("priority"), value.alias("value"), bound.alias("threshold"), status.alias("status"))

    return whole.select(F.explode(F.array(*[row(*r) for r in rules])).alias("r")).select("r.*")


def chunk_edges(rows: DataFrame, kind: str, relation: str) -> DataFrame:
    """Edges from things of a kind (``id``) to the chunks they stand in."""
    return rows.select(F.lit(kind).alias("from_type"), F.col("id").alias("from_id"), F.lit(relation).alias("relation"), F.col("chunk").cast("string").alias("to_id"))


def shared_chunk_edges(a: DataFrame, b: DataFrame, kind: str, relation: str) -> DataFrame:
    """Edges from things to others of the same chunk, once for each chunk that they share."""
    both = a.select("chunk", F.col("id").alias("from_id")).distinct().join(b.select("chunk", F.col("id").alias("to_id")).distinct(), "chunk")
    return both.select(F.lit(kind).alias("from_type"), "from_id", F.lit(relation).alias("relation"), "to_id")
