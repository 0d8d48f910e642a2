"""Further queries: questions, folds in Python, small ladders and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folds
from ..functions import questions as Q
from ..functions import text as X
from ..operators import filters as S
from ..operators import ordered as O
from ..operators import tokens as P
from ..sources.objects import training_key
from .registry import query

c = F.col


_DAY, _MONTH, _YEAR = (r"(^|[^0-9])((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})([^0-9]|$)", r"(^|[^0-9])((?:19|20)[0-9]{2}-[0-9]{2})([^0-9]|$)", r"(^|[^0-9])((?:19|20)[0-9]{2})([^0-9]|$)")


@query(f"""WITH q AS (SELECT doc_id, nullif(regexp_extract(text, '{_DAY}', 2), '') AS d, nullif(regexp_extract(text, '{_MONTH}', 2), '') AS m, nullif(regexp_extract(text, '{_YEAR}', 2), '') AS y FROM documents),
  f AS (SELECT doc_id, d, m, coalesce(TRY_CAST(d AS DATE), TRY_CAST(m || '-01' AS DATE), TRY_CAST(y || '-01-01' AS DATE))::TIMESTAMP AS a FROM q)
  SELECT doc_id, a AS valid_from, CASE WHEN d IS NOT NULL THEN a + INTERVAL 1 DAY WHEN m IS NOT NULL THEN a + INTERVAL 1 MONTH ELSE a + INTERVAL 1 YEAR END - INTERVAL 1 SECOND AS valid_to FROM f""")
def question_time_window(t):
    """The first day, month or year that stands in each whole text."""
    w = Q.time_window(c("text"))
    return t.documents.select("doc_id", w["from"].alias("valid_from"), w["to"].alias("valid_to"))


_INTENT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in Q.INTENTS) + " ELSE 'summary' END"


@query(f"""WITH i AS (SELECT conv_id, turn, {_INTENT} AS intent, length(text) % 2 = 0 AS heavy FROM conversations WHERE role = 'user')
  SELECT conv_id, turn, intent, CASE WHEN intent = 'timeline' THEN 'timeline_first' WHEN intent IN ('relation', 'attribute') OR heavy THEN 'entity_first' ELSE 'assertion_first' END AS mode FROM i""")
def question_intent(t):
    kind = Q.intent(c("text"))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", kind.alias("intent"), Q.retrieval_mode(kind, F.length("text") % 2 == 0).alias("mode"))


@query("""SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') AS terms FROM (SELECT conv_id, turn, (list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+'), lambda x: length(x) >= 4 AND x NOT IN ('with', 'that')))[1:8] AS w FROM conversations WHERE role = 'user')""")
def question_hint_terms(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.array_join(Q.hint_terms(c("text"), ("with", "that")), ",").alias("terms"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' || CASE WHEN source = 'src0' THEN ',hu' ELSE '' END WHEN 'es' THEN 'es' || CASE WHEN source = 'src0' THEN ',hu' ELSE '' END ELSE CASE WHEN source = 'src0' THEN 'hu' ELSE '' END END AS hints FROM documents")
def language_hint_codes(t):
    raw = F.concat(F.upper("lang"), F.lit("+ "), F.when(c("source") == "src0", "hun").otherwise("xx"), F.lit("+"), c("lang"))
    return t.documents.select("doc_id", F.array_join(Q.language_hints(raw), ",").alias("hints"))


@query("""SELECT source, CASE WHEN r <= 0 OR f >= n THEN 'failed' WHEN f > 0 OR v < r THEN 'partial' ELSE 'completed' END AS status FROM (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 100) AS f, count(*) FILTER (lang = 'en') AS r, count(*) FILTER (lang = 'en' AND n_chars > 50) AS v FROM documents GROUP BY 1)""")
def rebuild_status(t):
    en = c("lang") == "en"
    x = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("n_chars") < 100).alias("f"), F.count_if(en).alias("r"), F.count_if(en & (c("n_chars") > 50)).alias("v"))
    return x.select("source", Q.rebuild_status(c("n"), c("f"), c("r"), c("v"), F.lit(False)).alias("status"))


@query("""SELECT o_orderkey, (o_orderkey * 7 % 100 < o_orderkey % 100) OR (o_orderkey % 5 = 0 AND (1 + (o_orderkey + 1) % 3) < (1 + o_orderkey % 3)) AS scheduled FROM orders""")
def scheduled_changes(t):
    k = c("o_orderkey")
    period = lambda x: F.element_at(F.array(*[F.lit(p) for p in ("monthly", "quarterly", "yearly")]), (x % 3 + 1).cast("int"))
    return t.orders.select("o_orderkey", Q.scheduled_change(k % 100, k * 7 % 100, period(k), period(k + 1), k % 5 == 0).alias("scheduled"))


@query("""WITH x AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS p FROM orders GROUP BY 1)
  SELECT o_custkey, CASE WHEN greatest(o, f) > 0 AND greatest(o, f) >= p THEN CASE WHEN o >= f THEN 'O' ELSE 'F' END ELSE 'text' END AS kind FROM x""")
def dominant_chunk_type(t):
    kinds = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("k"))
    return kinds.select("o_custkey", Q.dominant_type(c("k"), ("O", "F")).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (json_extract_string(props, '$.k'))::VARCHAR ELSE 'new' END AS k, 'x' AS extra FROM events""")
def json_patch_merge(t):
    patch = F.when(c("event_id") % 2 == 0, '{"extra": "x"}').otherwise('{"k": "new", "extra": "x"}')
    m = Q.merged_json(c("props"), patch)
    return t.events.select("event_id", F.element_at(m, "k").alias("k"), F.element_at(m, "extra").alias("extra"))


@query("""WITH l AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l""")
def section_titles(t):
    """The nearest heading at or before each part."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.last(F.when(c("role") == "system", c("text")), ignorenulls=True).over(w).alias("section"))


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND (lang = 'en') AND source = 'src0'""")
def payload_filter(t):
    """Rows that aren't deleted, of a mandatory corpus and an optional language; absent filters are skipped."""
    rows = t.documents.join(t.labels, "doc_id", "left").where(c("quality").isNull())
    wanted = {"source": "src0", "lang": "en", "channel_id": "dropped", "doc_id": None}
    return S.given(rows, wanted, ignored=["channel_id"]).select("doc_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def issue_filters(t):
    """Status and severity filter independently; those not given are skipped."""
    return S.given(t.orders, {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}).select("o_orderkey")


@query("""SELECT vec_id, sha256('{"chunk_id":' || vec_id || ',"knowledge_base_id":' || label || ',"language":"' || coalesce(lang, 'unknown') || '","source":"' || coalesce(source, 'none') || '","status":"active","preview_chars":' || length(coalesce(substr(text, 1, 500), '')) || '}') AS payload_hash, coalesce(substr(text, 1, 500), '') AS preview
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id""")
def index_payload(t):
    """What is stored beside a vector, with a preview of 500 characters."""
    rows = t.embeddings.join(t.documents, c("vec_id") == c("doc_id"), "left").withColumn("preview", F.coalesce(F.substring("text", 1, 500), F.lit("")))
    payload = Q.point_payload(c("vec_id"), c("label"), c("lang"), c("source"), F.length("preview"))
    return rows.select("vec_id", F.sha2(payload, 256).alias("payload_hash"), "preview")


@query("""SELECT doc_id, CASE WHEN n_chars > 15000 THEN 'PART_TOO_LONG' WHEN len(string_split(text, chr(10))) > 60 THEN 'TOO_MANY_PARTS' END AS error FROM documents WHERE n_chars > 15000 OR len(string_split(text, chr(10))) > 60""")
def extract_limits(t):
    error = F.when(c("n_chars") > 15000, "PART_TOO_LONG").when(F.size(F.split("text", "\n")) > 60, "TOO_MANY_PARTS")
    return t.documents.select("doc_id", error.alias("error")).where(c("error").isNotNull())


@query()
def sentence_chunks(t):
    return t.documents.select("doc_id", F.posexplode(folds.sentence_chunks("text")).alias("chunk", "text"))


@query()
def canonical_payload_hash(t):
    return t.events.select("event_id", folds.canonical_json_hash("props").alias("h"))


@query()
def nested_redaction(t):
    raw = F.to_json(F.struct(c("c_name").alias("name"), F.struct(c("c_mktsegment").alias("api_key"), c("c_custkey").alias("id")).alias("inner")))
    return t.customer.select("c_custkey", folds.redacted_json(raw).alias("payload"))


@query()
def depersonalised_texts(t):
    """Tokens over all texts of a source, and whether each text comes back whole."""
    docs, tokens = P.depersonalise(t.documents.select("doc_id", "source", "text"), "doc_id", "text", "source")
    back = P.restored(docs, "doc_id", "encoded", "source", tokens)
    return back.select("doc_id", "source", "encoded", c("tokens").alias("n_tokens"), F.size("restored.spans").alias("n_restored"), (c("restored.text") == c("text")).alias("same"))


@query()
def place_mentions(t):
    """Sites, rooms, addresses and listed cities and regions in texts, from patterns and parameter lists."""
    return t.documents.select("doc_id", F.explode(X.places(c("text"))).alias("p")).select("doc_id", "p.*")


@query("""SELECT doc_id, sha256('{"item":' || doc_id || ',"path":["' || source || '"],"title":"' || lang || '","parts":[' || n_chars || ']}') AS h FROM documents""")
def chunk_parent_hash(t):
    return t.documents.select("doc_id", Q.section_hash(c("doc_id"), F.array("source"), c("lang"), F.array("n_chars")).alias("h"))


@query("""WITH new AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM new)) SELECT * FROM k UNION ALL SELECT o_orderkey, o_custkey, 'N' FROM new""")
def replace_for_key(t):
    """Rows of the replaced keys go, and the new ones come: an anti join and a union."""
    new = t.orders.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("N"))
    return t.orders.join(new.select("o_custkey").distinct(), "o_custkey", "left_anti").unionByName(new).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""WITH f AS (SELECT c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT c_custkey, c_acctbal, n::INTEGER AS rank FROM f WHERE n <= 3""")
def ranked_previews(t):
    from ..operators.aggregates import top_per_group

    return top_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), c("c_custkey")], 3).select("c_custkey", "c_acctbal", "rank")


@query("""SELECT event_id, ts, to_base64(('{"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || rtrim(rtrim('.' || strftime(ts, '%f'), '0'), '.') || '","id":' || event_id || '}')::BLOB) AS cursor FROM events ORDER BY ts, event_id LIMIT 10""")
def page_cursors(t):
    rows = t.events.orderBy("ts", "event_id").limit(10)
    return rows.select("event_id", "ts", F.regexp_replace(O.cursor_text(c("ts"), c("event_id")), r"\s", "").alias("cursor"))


_NAME = "CASE WHEN doc_id % 3 = 0 THEN ' jelentés ' || source || '.PDF' WHEN doc_id % 3 = 1 THEN source || '/' || lang || '.txt' ELSE '.é' || doc_id END"
_CLEAN = f"regexp_replace(trim({_NAME}), '[/\\\\]+', '_', 'g')"


@query(f"""SELECT doc_id, 'tenants/' || coalesce(source, 'default') || '/kb/' || lang || '/training/b_1/' || doc_id || '/' || CASE WHEN regexp_full_match({_CLEAN}, '[\\x00-\\x7f]*') THEN {_CLEAN}
  ELSE substr(sha256({_CLEAN}), 1, 16) || CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '' END END AS object_key FROM documents""")
def object_keys(t):
    """Keys of uploads: plain names, names with slashes, names beyond ASCII, and one that is no extension."""
    kind = c("doc_id") % 3
    plain, hidden = F.concat(c("source"), F.lit("/"), c("lang"), F.lit(".txt")), F.concat(F.lit(".é"), c("doc_id"))
    name = F.when(kind == 0, F.concat(F.lit(" jelentés "), c("source"), F.lit(".PDF"))).when(kind == 1, plain).otherwise(hidden)
    return t.documents.select("doc_id", training_key(c("source"), c("lang"), F.lit(" b//1 "), c("doc_id"), name).alias("object_key"))
