"""Retrieval and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ordered as O
from ..operators import retrieval as R
from ..operators import vectorsearch as V
from .registry import query

c = F.col
_N = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_U = f"list_transform(embedding, lambda x: x::DOUBLE / {_N})"
_DOT = "list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * q[i]))"
_V = f"p AS (SELECT vec_id, label, {_U} AS v FROM embeddings), qs AS (SELECT vec_id AS query_id, label, v AS q FROM p WHERE vec_id % 50 = 0)"
_TOP = f"{_V}, s AS (SELECT query_id, vec_id, round({_DOT}, 6) AS score FROM p JOIN qs USING (label) WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


def _points(t):
    return t.embeddings.select("vec_id", "label", c("embedding").alias("v"))


def _queries(t):
    return t.embeddings.where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "label", c("embedding").alias("q"))


def _knowledge(t):
    return t.labels.select(c("doc_id").alias("vec_id"), c("quality").cast("double").alias("knowledge_score"))


@query(f"""WITH {_TOP}, h AS (SELECT query_id, r.vec_id, score, round(0.75::DOUBLE * score + 0.25::DOUBLE * coalesce(nullif(quality::DOUBLE, 0.0), 0.5), 8) AS hybrid FROM r LEFT JOIN labels l ON l.doc_id = r.vec_id WHERE rank <= 10)
  SELECT query_id, vec_id, score, hybrid, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, vec_id)::INTEGER AS rank FROM h""")
def vector_hybrid_topk(t):
    hits = V.top_k(_points(t), _queries(t), 10, ["label"]).select("query_id", "vec_id", "score")
    return R.hybrid_rank(hits, _knowledge(t), "vec_id").select("query_id", "vec_id", "score", "hybrid", "rank")


@query(f"""WITH {_TOP}, st AS (SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5 AND query_id % 4 <> 0), lo AS (SELECT query_id, vec_id, round({_DOT}, 6) AS score FROM p, qs WHERE vec_id <> query_id AND query_id % 4 = 0),
  lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM lo) SELECT query_id, vec_id, score FROM st UNION ALL SELECT query_id, vec_id, score FROM lr WHERE rank <= 5""")
def vector_soft_language_fallback(t):
    """Every fourth query asks for a label that no point has."""
    queries = _queries(t).withColumn("label", F.when(c("query_id") % 4 == 0, -1).otherwise(c("label")))
    return V.soft_top_k(_points(t), queries, 5, ["label"]).select("query_id", "vec_id", "score")


@query("""SELECT doc_id, CASE WHEN v.vec_id IS NULL THEN 'generate' ELSE 'reuse' END AS action FROM documents d LEFT JOIN (SELECT DISTINCT vec_id, label FROM embeddings WHERE label < 5) v ON v.vec_id = d.doc_id AND v.label = d.doc_id % 5""")
def embedding_reuse_lookup(t):
    done = t.embeddings.where("label < 5").select("vec_id", "label").distinct()
    rows = t.documents.select("doc_id", (c("doc_id") % 5).cast("int").alias("label"))
    return rows.join(done, (c("doc_id") == c("vec_id")) & (rows["label"] == done["label"]), "left").select("doc_id", F.when(c("vec_id").isNull(), "generate").otherwise("reuse").alias("action"))


@query(f"""WITH {_TOP} SELECT query_id, r.vec_id, rank::INTEGER AS rank, coalesce(substr(text, 1, 480), 'missing') AS snippet, coalesce(lang, 'unknown') AS language FROM r LEFT JOIN documents d ON d.doc_id = r.vec_id AND d.lang <> 'de' WHERE rank <= 5""")
def hydrated_hits(t):
    hits = V.top_k(_points(t), _queries(t), 5, ["label"]).select("query_id", "vec_id", "rank")
    chunks = t.documents.where("lang <> 'de'").select(c("doc_id").alias("vec_id"), F.substring("text", 1, 480).alias("snippet"), c("lang").alias("language"))
    return R.hydrate(hits, chunks, "vec_id", {"snippet": F.lit("missing"), "language": F.lit("unknown")})


def _ranked(documents):
    """Every document as a hit of some query, six to a query."""
    rows = documents.select(F.floor(c("doc_id") / 6).alias("query_id"), "doc_id", "text", "source")
    return O.ranked(rows, ["query_id"], ["doc_id"])


@query("""WITH r AS (SELECT doc_id // 6 AS query_id, doc_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id // 6 ORDER BY doc_id) AS k FROM documents),
  w AS (SELECT query_id, list(n ORDER BY k) AS ns, list(doc_id ORDER BY k) AS ds FROM r WHERE k <= 6 GROUP BY 1),
  s AS (SELECT query_id, ds, list_reduce(list_prepend([0::BIGINT], list_transform(ns, lambda x: [x])), lambda a, x: list_append(a, least(x[1], greatest(120, 4000 - list_sum(a))))) AS us FROM w)
  SELECT query_id, ds[i] AS doc_id, i::INTEGER AS block, us[i + 1]::INTEGER AS used FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM s)""")
def context_budget(t):
    return O.context_blocks(_ranked(t.documents), ["query_id"], "rank", "text", "doc_id").select("query_id", "doc_id", "block", "used")


@query("""WITH r AS (SELECT doc_id // 6 AS query_id, doc_id, source, row_number() OVER (PARTITION BY doc_id // 6 ORDER BY doc_id) AS rank FROM documents),
  f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM f WHERE n = 1)
  SELECT query_id, doc_id, position::INTEGER AS position, 'c' || query_id || '-' || rank AS citation_id, '/api/kb/items/' || source || '/download' AS download_url FROM p WHERE position <= 8""")
def source_list(t):
    kept = R.sources(_ranked(t.documents), "query_id", ["source"], "rank")
    return R.citations(kept, "query_id", "rank", "source").select("query_id", "doc_id", "position", "citation_id", "download_url")


@query("""WITH x AS (SELECT user_id, event_type, max(value) / 500 AS score FROM events GROUP BY 1, 2), f AS (SELECT *, greatest(0.35::DOUBLE, 0.8::DOUBLE * max(score) OVER (PARTITION BY user_id)) AS floor FROM x)
  SELECT user_id, event_type, round(score, 6) AS score FROM f WHERE score >= floor""")
def packet_gate(t):
    x = t.events.groupBy("user_id", "event_type").agg((F.max("value") / 500).alias("score"))
    return R.packet_floor(x, "user_id", "score").select("user_id", "event_type", F.round("score", 6).alias("score"))


@query("""WITH x AS (SELECT user_id, count(*) AS n, max(value) / 500 AS best FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'BLOCKED_NOT_READY' WHEN n = 0 OR best < 0.9::DOUBLE THEN 'NO_ANSWER' ELSE 'ANSWERED' END AS decision,
  concat_ws(',', CASE WHEN user_id % 10 = 0 THEN 'NOT_INDEXED' END, CASE WHEN n < 5 THEN 'FEW_CHUNKS' END) AS reasons FROM x""")
def grounding_and_readiness(t):
    x = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), (F.max("value") / 500).alias("best"))
    reasons = R.blocking_reasons({"NOT_INDEXED": c("user_id") % 10 == 0, "FEW_CHUNKS": c("n") < 5})
    return x.select("user_id", R.grounding(c("user_id") % 10 != 0, c("n"), c("best"), 0.9).alias("decision"), F.array_join(reasons, ",").alias("reasons"))


@query("""WITH r AS (SELECT *, sum(length(text) + 10) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS running FROM conversations) SELECT conv_id, turn, running::BIGINT AS running FROM r WHERE running <= 1500""")
def history_budget(t):
    return O.suffix_within(t.conversations, ["conv_id"], ["turn"], F.length("text") + 10, 1500).select("conv_id", "turn", "running")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), r AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS running FROM l WHERE n <= 4)
  SELECT conv_id, turn, running::BIGINT AS running FROM r WHERE running <= 2500""")
def history_trim(t):
    from pyspark.sql import Window as W

    last = t.conversations.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 4")
    return O.suffix_within(last, ["conv_id"], ["turn"], F.length("text"), 2500).select("conv_id", "turn", "running")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations""")
def previous_user_turn(t):
    return O.previous_value(t.conversations, ["conv_id"], "turn", c("role") == "user", "text", "previous").select("conv_id", "turn", "previous")


@query("""WITH x AS (SELECT event_id, ts, event_type, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, coalesce(epoch(ts) - epoch(before) <= 300 AND kind = event_type, false) AS followup FROM x""")
def followup_flag(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = lambda x: F.unix_micros(x.cast("timestamp")) / 1_000_000
    close = seconds(c("ts")) - seconds(F.lag("ts").over(w)) <= 300
    return t.events.select("event_id", F.coalesce(close & (F.lag("event_type").over(w) == c("event_type")), F.lit(False)).alias("followup"))


@query("""SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[.!?]+')) > 4 OR len(regexp_split_to_array(trim(text), '\\s+')) > 30 THEN 'rejected' WHEN len(regexp_extract_all(text, '[.!?]+')) > 2 THEN 'shortened' ELSE 'accepted' END AS gate FROM conversations WHERE role = 'user'""")
def question_gate(t):
    sentences, words = F.regexp_count("text", F.lit("[.!?]+")), F.size(F.split(F.trim("text"), r"\s+"))
    gate = F.when((sentences > 4) | (words > 30), "rejected").when(sentences > 2, "shortened").otherwise("accepted")
    return t.conversations.where("role = 'user'").select("conv_id", "turn", gate.alias("gate"))


@query("""SELECT doc_id, concat_ws(chr(10), 'Source: ' || source, CASE WHEN lang <> 'en' THEN 'Language: ' || lang END, 'Length: ' || n_chars) AS header, substr(text, 1, 500) AS preview FROM documents""")
def embedding_input(t):
    header = F.concat_ws("\n", F.concat(F.lit("Source: "), c("source")), F.when(c("lang") != "en", F.concat(F.lit("Language: "), c("lang"))), F.concat(F.lit("Length: "), c("n_chars")))
    return t.documents.select("doc_id", header.alias("header"), F.substring("text", 1, 500).alias("preview"))


@query("""SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def vector_store_retrieve_delete(t):
    """Retrieve by ids is a semi join, delete by ids an anti join."""
    good, bad = t.labels.where("quality = 1"), t.labels.where("toxic = 1")
    kept = t.embeddings.join(good, c("vec_id") == c("doc_id"), "left_semi")
    return kept.join(bad, c("vec_id") == c("doc_id"), "left_anti").select("vec_id", "label")


@query()
def pseudo_embedding(t):
    from ..functions.folds import hash_embedding, point_id

    return t.documents.select("doc_id", hash_embedding("text").alias("v"), point_id(c("doc_id").cast("string")).alias("point_id")).select("doc_id", "point_id", F.size("v").alias("dim"), F.sha2(F.array_join(F.transform("v", lambda x: F.format_string("%.8f", x)), ","), 256).alias("vector_hash"))


@query()
def lead_and_preview(t):
    return t.documents.select("doc_id", X.lead_sentence(c("text")).alias("lead"), X.preview(c("text")).alias("preview"))
