"""Language, keyword, topic, entity, graph and score queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.recognisers import Companies, Identifiers, recognised
from ..operators import aggregates as A
from ..operators import dictionary as D
from ..operators import knowledge as K
from ..operators.companies import find_companies
from .registry import query

c = F.col
#: Our own marker words of the four languages in the tables, topics by marker, and stop words (parameters).
MARKERS = {"en": ("the", "of", "and", "to", "is", "that", "it", "for", "was", "with"), "de": ("der", "die", "und", "den", "von", "das", "mit", "ist", "zu", "dem"), "fr": ("le", "les", "des", "et", "une", "dans", "pour", "du", "est", "au"), "es": ("el", "los", "las", "que", "por", "del", "y", "para", "una", "con")}
TOPICS = {"articles": (("the", "der", "le", "el"), 1.0), "joining": (("and", "und", "et", "y"), 0.9), "contempt": (("worthless", "pathetic", "disgusting", "trash"), 1.1)}
STOPWORDS = tuple(sorted({w for words in MARKERS.values() for w in words}))
_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_-]+')"
_TOK = f"tok AS (SELECT doc_id, x FROM (SELECT doc_id, unnest({_TOKENS}) AS x FROM documents) WHERE length(x) >= 2)"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


_LANG_ROWS = " UNION ALL ".join(f"SELECT '{lang}' AS code, '{w}' AS marker" for lang, ws in MARKERS.items() for w in ws)
_LANG = f"""m AS ({_LANG_ROWS}), {_TOK}, d AS (SELECT DISTINCT doc_id, x FROM tok), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
  s AS (SELECT d.doc_id, code, count(*) AS hits FROM d JOIN m ON x = marker GROUP BY 1, 2),
  r AS (SELECT s.doc_id, code, round_even(hits::DOUBLE / n, 4) AS score, row_number() OVER (PARTITION BY s.doc_id ORDER BY round_even(hits::DOUBLE / n, 4) DESC, code) AS k FROM s JOIN n USING (doc_id)),
  l AS (SELECT documents.doc_id, CASE WHEN a.score IS NULL OR a.score = 0 THEN 'unknown' WHEN b.score > 0 AND b.score >= a.score * 0.7::DOUBLE THEN 'mixed' ELSE a.code END AS language,
   CASE WHEN a.score IS NULL THEN 0.0 WHEN b.score > 0 AND b.score >= a.score * 0.7::DOUBLE THEN round_even((a.score + b.score) / 2, 4) ELSE a.score END AS confidence
   FROM documents LEFT JOIN (SELECT * FROM r WHERE k = 1) a ON a.doc_id = documents.doc_id LEFT JOIN (SELECT * FROM r WHERE k = 2) b ON b.doc_id = documents.doc_id)"""


@query(f"WITH {_LANG} SELECT doc_id, language, round(confidence, 4) AS confidence FROM l")
def language_detect(t):
    return K.detect_language(t.documents, "doc_id", X.tokens(c("text")), MARKERS).select("doc_id", "language", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_LANG}, w AS (SELECT source, language, sum(confidence) AS s, count(*) AS n FROM l JOIN documents USING (doc_id) GROUP BY 1, 2), g AS (SELECT *, sum(s) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY round(s, 6) DESC, language) AS k FROM w) SELECT source, language, round(s / total, 4) AS share, n FROM g WHERE k = 1")
def document_language(t):
    found = K.detect_language(t.documents, "doc_id", X.tokens(c("text")), MARKERS).join(t.documents.select("doc_id", "source"), "doc_id")
    sums = found.groupBy("source", "language").agg(F.sum("confidence").alias("s"), F.count("*").alias("n"))
    best = A.top_per_group(sums.withColumn("total", F.sum("s").over(W.partitionBy("source"))), ["source"], [F.desc(F.round("s", 6)), c("language")], 1)
    return best.select("source", "language", F.round(c("s") / c("total"), 4).alias("share"), "n")


@query(f"WITH {_TOK}, k AS (SELECT * FROM tok WHERE x NOT IN {_STOP}), n AS (SELECT doc_id, count(*) AS total FROM k GROUP BY 1) SELECT doc_id, x AS term, count(*) AS frequency, round(count(*)::DOUBLE / any_value(total), 6) AS tf FROM k JOIN n USING (doc_id) GROUP BY 1, 2")
def term_frequency(t):
    return K.term_frequency(t.documents, "doc_id", X.tokens(c("text")), STOPWORDS).select("doc_id", c("token").alias("term"), "frequency", F.round("tf", 6).alias("tf"))


@query(f"WITH {_TOK}, k AS (SELECT doc_id, x, count(*) AS f FROM tok WHERE x NOT IN {_STOP} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, x) AS rank FROM k) SELECT doc_id, x AS term, rank::INTEGER AS rank, f AS frequency FROM r WHERE rank <= 25")
def keyword_topk(t):
    return K.top_terms(t.documents, "doc_id", X.tokens(c("text")), STOPWORDS, 25).select("doc_id", c("token").alias("term"), "rank", "frequency")


@query()
def phrase_keywords(t):
    """Phrases of up to three words with their best score; a look-behind keeps SQL engines from saying the same."""
    rows = t.documents.select("doc_id", F.explode(X.phrases(c("text"))).alias("term"))
    words = F.size(F.split("term", r"\s"))
    return rows.groupBy("doc_id", "term").agg(F.max(F.lit(0.5) + F.lit(0.1) * words).alias("score"))


_TOPIC_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS topic, '{m}' AS marker, {w}::DOUBLE AS weight" for k, (ms, w) in TOPICS.items() for m in ms)


@query(f"WITH m AS ({_TOPIC_ROWS}), {_TOK}, d AS (SELECT DISTINCT doc_id, x FROM tok), h AS (SELECT doc_id, topic, count(*) AS hits, any_value(weight) AS weight FROM d JOIN m ON x = marker GROUP BY 1, 2) SELECT doc_id, topic, hits, round(least(1.0, (0.45::DOUBLE + 0.12::DOUBLE * hits) * weight), 4) AS confidence FROM h")
def topic_match(t):
    return K.match_topics(t.documents, "doc_id", X.tokens(c("text")), TOPICS).select("doc_id", "topic", "hits", F.round("confidence", 4).alias("confidence"))


_RULES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS topic, " + " + ".join(f"(strpos(x, '{m}') > 0)::BIGINT + list_contains(k, '{m}')::BIGINT" for m in ms) + " AS hits FROM d" for k, (ms, _) in TOPICS.items())


@query(f"WITH d AS (SELECT doc_id, lower(text) AS x, list_filter({_TOKENS}, lambda w: length(w) >= 2) AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, topic, hits FROM ({_RULES}) WHERE hits > 0")
def topic_rules(t):
    """Markers inside the texts and among their words."""
    return K.match_topic_rules(t.documents, "doc_id", F.lower("text"), X.tokens(c("text")), {k: ms for k, (ms, _) in TOPICS.items()})


@query("""SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE strpos(d.text, b.text) > 0""")
def dictionary_in_text(t):
    """Long terms inside texts, as they are."""
    entries = t.benchmark.select(c("item_id").alias("entry"), c("text").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).alias("confidence"))
    found = D.find_terms(t.documents, "doc_id", "text", entries, words=False)
    return found.select("doc_id", c("entry").cast("long").alias("item_id")).distinct()


@query()
def dictionary_mentions(t):
    """Names and aliases, taken from the benchmark's first words, as words of any case and accent in the documents."""
    w = F.split("text", r"\s+")
    entries = t.benchmark.select(c("item_id").alias("entry"), F.upper(F.array_join(F.slice(w, 1, 2), " ")).alias("name"), F.array(F.get(w, F.lit(2)), F.initcap(F.get(w, F.lit(3)))).alias("aliases"), F.when(c("item_id") % 5 > 0, (c("item_id") % 5) / 10).alias("confidence"))
    return D.find_terms(t.documents, "doc_id", "text", entries)


@query("""WITH x AS (SELECT user_id, event_type AS kind, floor(value / 50)::BIGINT AS name, value / 500 AS confidence, event_id FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind, name ORDER BY confidence DESC, event_id) AS k FROM x) SELECT user_id, kind, name, event_id FROM r WHERE k = 1""")
def candidate_merge(t):
    rows = t.events.select("user_id", c("event_type").alias("kind"), F.floor(c("value") / 50).alias("name"), (c("value") / 500).alias("confidence"), "event_id")
    return K.best_candidates(rows, ["user_id", "kind", "name"], "confidence", "event_id").select("user_id", "kind", "name", "event_id")


@query("""SELECT event_type AS kind, user_id AS name, round(max(value), 6) AS confidence, count(DISTINCT CAST(ts AS DATE)) AS n_chunks, array_to_string(list_sort(list(DISTINCT strftime(ts, '%d'))), ',') AS chunks FROM events GROUP BY 1, 2""")
def entity_merge(t):
    rows = t.events.select(c("event_type").alias("kind"), c("user_id").alias("name"), "value", F.date_format("ts", "dd").alias("chunk"))
    out = K.merge_entities(rows, ["kind", "name"], "value", "chunk")
    return out.select("kind", "name", F.round("confidence", 6).alias("confidence"), F.size("chunks").cast("long").alias("n_chunks"), F.array_join("chunks", ",").alias("chunks"))


_EDGES = """e AS (SELECT 'user' AS from_type, user_id AS from_id, 'did' AS relation, event_type AS to_id, count(*) AS weight FROM events GROUP BY 2, 4
  UNION ALL SELECT 'nation', n_nationkey, 'in', r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'customer', c_custkey, 'of', n_name, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _edges(t):
    did = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("weight")).select(F.lit("user").alias("from_type"), c("user_id").alias("from_id"), F.lit("did").alias("relation"), c("event_type").alias("to_id"), "weight")
    placed = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select(F.lit("nation").alias("from_type"), c("n_nationkey").cast("long").alias("from_id"), F.lit("in").alias("relation"), c("r_name").alias("to_id"), F.lit(1).cast("long").alias("weight"))
    of = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select(F.lit("customer").alias("from_type"), c("c_custkey").alias("from_id"), F.lit("of").alias("relation"), c("n_name").alias("to_id"), F.lit(1).cast("long").alias("weight"))
    return K.edge_union([did, placed, of])


@query(f"WITH {_EDGES} SELECT from_type, from_id, relation, to_id, weight::BIGINT AS weight FROM e")
def edge_union(t):
    return _edges(t)


@query(f"WITH {_EDGES} SELECT count(*) FILTER (relation = 'did') AS actions, count(*) FILTER (relation IN ('in', 'of')) AS places, count(*) FILTER (from_type = 'user') AS users, count(*) FILTER (weight > 5) AS strong, count(*) AS total FROM e")
def edge_group_counts(t):
    return A.conditional_counts(_edges(t), {"actions": c("relation") == "did", "places": c("relation").isin("in", "of"), "users": c("from_type") == "user", "strong": c("weight") > 5, "total": F.lit(True)})


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events), t AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE value > 200)
  SELECT event_type, count(DISTINCT user_id || '-' || day) AS n_chunks, count(*) AS n_pairs FROM e JOIN t USING (user_id, day) GROUP BY 1""")
def mention_entity_join(t):
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    topics = rows.where("value > 200").select("user_id", "day").distinct()
    return rows.join(topics, ["user_id", "day"]).groupBy("event_type").agg(F.countDistinct("user_id", "day").alias("n_chunks"), F.count("*").alias("n_pairs"))


@query("""WITH k AS (SELECT doc_id, n_chars, CASE WHEN quality = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS lang_conf, least(1.0, (doc_id % 8) / 5.0::DOUBLE) AS ent, least(1.0, (doc_id % 13) / 10.0::DOUBLE) AS kw, least(1.0, 0.3::DOUBLE * (doc_id % 4)) AS top,
   CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS tem, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS spa, least(1.0, (doc_id % 6) / 3.0::DOUBLE) AS pro FROM documents LEFT JOIN labels USING (doc_id))
  SELECT doc_id, round_even(least(1.0, 0.08::DOUBLE * lang_conf + 0.06::DOUBLE * 1.0 + 0.10::DOUBLE * 0.7::DOUBLE + 0.10::DOUBLE * ent + 0.12::DOUBLE * kw + 0.10::DOUBLE * top + 0.08::DOUBLE * tem + 0.08::DOUBLE * spa + 0.08::DOUBLE * pro + 0.10::DOUBLE * 0.2::DOUBLE + 0.10::DOUBLE * 0.4::DOUBLE + 0.10::DOUBLE * 0.6::DOUBLE), 3) AS knowledge_score FROM k""")
def knowledge_score(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    d = c("doc_id")
    score = K.knowledge_score(language_confidence=F.when(c("quality") == 1, 0.9).otherwise(0.5), structure_score=K.structure_score(F.lit(True), F.lit("text")), entities=d % 8, keywords=d % 13, topics=d % 4, temporal=F.when(d % 3 == 0, 1).otherwise(0), spatial=F.when(d % 5 == 0, 1).otherwise(0), processes=d % 6, relationship_score=F.lit(0.2), content_type=F.lit("general_text"), source_type=F.lit("text"))
    return rows.select("doc_id", F.bround(score, 3).alias("knowledge_score"))


@query("""WITH d AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (n_chars < 200) AS short FROM documents GROUP BY 1)
  SELECT source, round(en::DOUBLE / n, 4) AS en_ratio, concat_ws(',', CASE WHEN en::DOUBLE / n < 0.6 THEN 'LOW_EN' END, CASE WHEN short > 3 THEN 'SHORT_TEXTS' END, CASE WHEN n > 45 THEN 'LARGE' END) AS warnings FROM d""")
def quality_ratios(t):
    d = A.conditional_counts(t.documents, {"n": F.lit(True), "en": c("lang") == "en", "short": c("n_chars") < 200}, ["source"])
    ratio = c("en") / c("n")
    return d.select("source", F.round(ratio, 4).alias("en_ratio"), K.warnings({"LOW_EN": ratio < 0.6, "SHORT_TEXTS": c("short") > 3, "LARGE": c("n") > 45}).alias("warnings"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <> count(DISTINCT o_orderpriority)")
def duplicated_keywords(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("d")).where("n <> d").select("o_custkey")


@query("SELECT user_id, array_to_string((list_sort(list(DISTINCT event_type)))[1:3], ',') AS previews, count(*) AS n FROM events GROUP BY 1")
def list_previews(t):
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"), F.count("*").alias("n")).select("user_id", F.array_join(F.slice("s", 1, 3), ",").alias("previews"), "n")


#: Legal forms of several languages, one of which goes with each document's company (parameters).
_LEGAL_FORMS = ("GmbH", "AG", "S.L.", "SpA", "Ltd.", "Zrt.", "Sociedad Anónima", "gmbh")


@query()
def company_mentions(t):
    """Companies in the documents; each text ends with one that is called after its first words, with a legal form that its language may lack."""
    form = F.element_at(F.array(*[F.lit(x) for x in _LEGAL_FORMS]), (F.pmod("doc_id", F.lit(len(_LEGAL_FORMS))) + 1).cast("int"))
    called = F.initcap(F.substring_index(F.coalesce("text", F.lit("")), " ", 2))
    texts = t.documents.select("doc_id", "lang", F.concat_ws(" ", "text", F.lit("signed by"), F.concat(called, F.when(c("doc_id") % 3 == 0, ",").otherwise("")), form, F.lit("and others")).alias("text"))
    return find_companies(texts, "doc_id", "text", c("lang")).select("doc_id", "name", "start", "end", "legal_form", "suffix", F.array_join("words", "|").alias("words"), "stop", "normalized", "confidence")


@query()
def recognised_mentions(t):
    """Companies and identifiers of the documents by one table function."""
    return recognised(t.documents, ["doc_id"], "text", "lang", {"company": Companies(), "identifier": Identifiers()})
