"""Text queries: normalising, classifying, recognising."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cleaning as C
from ..operators import ordered as O
from .registry import query

c = F.col
_LINES = "lines AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i + 1] AS line FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS i))"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(f"""WITH {_LINES}, t AS (SELECT *, {_TRIM.format("line")} AS bare FROM lines), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS k FROM t)
  SELECT doc_id, line_no::INTEGER AS line_no, bare, k AS n_times FROM n WHERE bare <> '' AND length(bare) <= 80 AND k >= 3""")
def repeated_lines(t):
    from pyspark.sql import Window as W

    bare = _lines(t).withColumn("bare", X.strip(c("line")))
    return bare.withColumn("n_times", F.count("*").over(W.partitionBy("doc_id", "bare"))).where((c("bare") != "") & (F.length("bare") <= 80) & (c("n_times") >= 3)).select("doc_id", "line_no", "bare", "n_times")


@query(f"""WITH {_LINES}, t AS (SELECT *, {_TRIM.format("line")} AS bare FROM lines), p AS (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM t)
  SELECT doc_id, count(*) FILTER (bare = before AND bare <> '') AS n_removed FROM p GROUP BY 1""")
def consecutive_dedupe(t):
    rows = C.held(t.documents.select("doc_id", F.split("text", "\n").alias("lines")), "kept", X.without_consecutive_repeats(c("lines")))
    return rows.select("doc_id", (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"))


@query(f"""WITH {_LINES}, a AS (SELECT doc_id, line_no, line, {_TRIM.format("line")} AS bare FROM lines WHERE NOT regexp_matches(line, '^\\s*(?:-\\s*)?(?:page\\s+)?\\d{{1,4}}(?:\\s*[./]\\s*\\d{{1,4}})?(?:\\s*-)?(?:\\s*\\.?\\s*oldal)?\\s*$', 'i')),
  b AS (SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS k FROM a), d AS (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM b WHERE NOT (bare <> '' AND length(bare) <= 80 AND k >= 3)),
  e AS (SELECT doc_id, string_agg(regexp_replace(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' +$', ''), chr(10) ORDER BY line_no) AS x FROM d WHERE bare = '' OR before IS NULL OR bare <> before GROUP BY 1)
  SELECT doc_id, sha256({_TRIM.format("regexp_replace(coalesce(x, ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS normal_hash FROM documents LEFT JOIN e USING (doc_id)""")
def normalise_documents(t):
    clean = C.normalise(t.documents.select("doc_id", "text"), "text", "normal")
    return clean.select("doc_id", F.sha2("normal", 256).alias("normal_hash"))


_BLOCK_SQL = """WITH b AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents), d AS (SELECT *, regexp_replace(x, '[^\\p{L}]', '', 'g') AS letters FROM b),
  k AS (SELECT CASE WHEN x = '' THEN 'unknown' WHEN regexp_matches(x, '^\\s*(?:warning|caution|important|attention)\\s*[:!]', 'i') THEN 'warning'
    WHEN regexp_matches(x, '^\\s*(?:note|info|tipp|tip)\\s*[:!]', 'i') THEN 'note' WHEN regexp_matches(x, '^\\s*(?:q|k|question)\\s*[:.]', 'i') THEN 'faq'
    WHEN regexp_matches(x, '^\\s*(?:[-*•]|[a-zA-Z]\\))\\s+\\S+') THEN 'list'
    WHEN length(x) <= 120 AND (regexp_matches(x, '^#{1,6}\\s+\\S+') OR (NOT regexp_matches(x, '[.;,]$') AND (regexp_matches(x, '^\\d+(?:\\.\\d+){0,5}\\.?\\s+\\S+') OR (letters <> '' AND NOT regexp_matches(letters, '[^\\p{Lu}]'))
      OR (len(regexp_split_to_array(x, '\\s+')) <= 8 AND NOT regexp_matches(x, '[.!?]'))))) THEN 'heading' ELSE 'paragraph' END AS kind FROM d)
  SELECT kind, count(*) AS n FROM k GROUP BY 1"""


@query(_BLOCK_SQL)
def block_classify(t):
    rows = t.documents.select(F.explode(F.split("text", "\n")).alias("x")).select(X.strip(c("x")).alias("x"))
    return rows.select(X.block_type(c("x"), F.lit(False)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'table' WHEN doc_id % 7 = 1 THEN 'text' END AS chunk_type, text FROM documents)
  SELECT doc_id, CASE WHEN chunk_type = 'table' THEN 'table' WHEN regexp_matches(text, '(?m)^\\s*\\d+\\.\\s+\\S') THEN 'process'
   WHEN regexp_matches(text, '(?im)^\\s*(?:mi|milyen|hogyan|what|how|why|when)[^\\p{L}\\p{N}_\\n].*\\?\\s*$') THEN 'faq' WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(policy|must not|prohibited)([^\\p{L}\\p{N}_]|$)') THEN 'policy'
   WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(warning)([^\\p{L}\\p{N}_]|$)') THEN 'warning' WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(guide|how to|tutorial)([^\\p{L}\\p{N}_]|$)') THEN 'guide'
   WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(click|open|select)([^\\p{L}\\p{N}_]|$)') THEN 'process' WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(note|remark)([^\\p{L}\\p{N}_]|$)') THEN 'note'
   WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(definition)([^\\p{L}\\p{N}_]|$)') THEN 'definition' WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(see also|reference)([^\\p{L}\\p{N}_]|$)') THEN 'reference' ELSE 'general_text' END AS content_type FROM d""")
def content_type_detect(t):
    kind = F.when(c("doc_id") % 7 == 0, "table").when(c("doc_id") % 7 == 1, "text")
    return t.documents.select("doc_id", X.content_type(c("text"), kind)["content_type"].alias("content_type"))


@query("""WITH u AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '\\b[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[\\p{L}\\p{N}_]{2,}\\b')) AS name FROM documents
  UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\\b(?:\\+36|06)[\\s-]?\\d{1,2}[\\s-]?\\d{3}[\\s-]?\\d{4}\\b')) FROM documents
  UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, '\\bhttps?://[\\p{L}\\p{N}_./?=&%-]+')) FROM documents
  UNION ALL SELECT doc_id, 'ticket_id', unnest(regexp_extract_all(text, '\\b[A-Z][A-Z0-9]{1,9}-\\d{1,6}\\b')) FROM documents
  UNION ALL SELECT doc_id, 'contract_number', unnest(regexp_extract_all(text, '(?i)\\b(?:SZERZ|SZ|CTR|K)[-/]?\\d{2,4}[-/]\\d{1,6}\\b')) FROM documents
  UNION ALL SELECT doc_id, 'invoice_number', unnest(regexp_extract_all(text, '(?i)\\b(?:SZLA|INV)[-/]?\\d{2,4}[-/]?\\d{1,8}\\b')) FROM documents)
  SELECT doc_id, kind, name, count(*) AS n FROM u GROUP BY 1, 2, 3""")
def identifier_mentions(t):
    return t.documents.select("doc_id", F.explode(X.identifiers(c("text"))).alias("x")).groupBy("doc_id", "x.kind", "x.name").agg(F.count("*").alias("n")).select("doc_id", "kind", "name", "n")


@query("""SELECT c_custkey, CASE WHEN strpos(e, '@') > 0 THEN substr(split_part(e, '@', 1), 1, 1) || repeat('*', greatest(length(split_part(e, '@', 1)) - 1, 1)) || '@' || split_part(e, '@', 2) ELSE '***' END AS masked
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE lower(c_mktsegment) || c_custkey || '@example.com' END AS e FROM customer)""")
def email_mask(t):
    address = F.when(c("c_custkey") % 10 == 0, c("c_name")).otherwise(F.concat(F.lower("c_mktsegment"), c("c_custkey"), F.lit("@example.com")))
    return t.customer.select("c_custkey", X.mask_email(address).alias("masked"))


@query("""SELECT doc_id, sha256(substr(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+', '[email]', 'g'), '\\+\\d[\\d \\-]{7,}\\d', '[phone]', 'g'), '\\d{6,}', '[number]', 'g'), 1, 400)) AS h FROM documents""")
def redaction(t):
    return t.documents.select("doc_id", F.sha2(X.redact(c("text")), 256).alias("h"))


@query("""SELECT doc_id, length(text) > 0 AS filled, greatest(1, length(text) // 4)::INTEGER AS tokens, sha256(text) AS checksum, CASE WHEN n_chars <= 500 THEN 'S' ELSE 'L' END AS size_class FROM documents""")
def chunk_facts(t):
    return t.documents.select("doc_id", (F.length("text") > 0).alias("filled"), X.token_estimate(c("text")).alias("tokens"), F.sha2("text", 256).alias("checksum"), F.when(c("n_chars") <= 500, "S").otherwise("L").alias("size_class"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN greatest(1, round_even(n_chars * 1.0, 0))::BIGINT WHEN 1 THEN greatest(1, round_even(n_chars * 0.06::DOUBLE, 0))::BIGINT WHEN 2 THEN greatest(1, round_even(n_chars * 0.2::DOUBLE, 0))::BIGINT ELSE greatest(1, round_even(n_chars * 0.35::DOUBLE, 0))::BIGINT END AS characters,
  CASE WHEN n_chars * 20000 <= 20971520 THEN 'memory' WHEN n_chars * 20000 <= 209715200 THEN 'temp_file' WHEN n_chars * 20000 <= 1048576000 THEN 'stream' ELSE 'reject' END AS strategy FROM documents""")
def upload_estimate(t):
    kind = F.element_at(F.array(F.lit("a.txt"), F.lit("b.PDF"), F.lit("c.docx"), F.lit("d.bin")), (c("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", X.upload_characters(kind, c("n_chars")).alias("characters"), X.extract_strategy(c("n_chars") * 20000).alias("strategy"))


@query("SELECT page_id, nullif(lower(regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+)', 1)), '') AS origin FROM pages")
def origin_normalise(t):
    return t.pages.select("page_id", X.origin(c("url")).alias("origin"))


@query("SELECT doc_id, lang, CASE WHEN regexp_matches(text, '[áéíóöőúüűÁÉÍÓÖŐÚÜŰ]') THEN 'hu' WHEN regexp_matches(lower(text), '(^|[^\\p{L}])(the|what|how|is|are|of|and|to|in|for)([^\\p{L}]|$)') THEN 'en' ELSE 'hu' END AS guess FROM documents")
def question_language(t):
    return t.documents.select("doc_id", "lang", X.question_language(c("text")).alias("guess"))


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 4""")
def edit_distance_pairs(t):
    a, b = (t.nation.select(c("n_regionkey"), c("n_name").alias(x), c("n_nationkey").alias(f"k{x}")) for x in "ab")
    return a.join(b, "n_regionkey").where((c("ka") < c("kb")) & (F.levenshtein("a", "b") <= 4)).select("a", "b")


@query("""SELECT doc_id, sha256(strip_accents(text)) AS folded FROM documents""")
def accent_fold(t):
    return t.documents.select("doc_id", F.sha2(X.fold_accents(c("text")), 256).alias("folded"))


_WORDS_OF = "list_distinct(string_split_regex(lower({}), '\\s+'))"


@query(f"""WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS a FROM pages), j AS (SELECT page_id, a, coalesce(text, '') AS b FROM p LEFT JOIN documents ON doc_id = page_id)
  SELECT page_id, contains(lower(b), lower(a)) OR contains(lower(a), lower(b)) OR len(list_intersect({_WORDS_OF.format("a")}, string_split_regex(lower(b), '\\s+')))::DOUBLE / len({_WORDS_OF.format("a")}) >= 0.9::DOUBLE AS repeats FROM j""")
def ocr_duplicate(t):
    """Whether a page's whole text says nothing that the document of its number doesn't."""
    bare = t.pages.select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("a"))
    both = bare.join(t.documents.select(c("doc_id").alias("page_id"), "text"), "page_id", "left").withColumn("b", F.coalesce("text", F.lit("")))
    return both.select("page_id", X.ocr_repeats(c("a"), c("b")).alias("repeats"))


@query("""SELECT doc_id, CASE WHEN count(*) FILTER (bad) = count(*) THEN 'FAILED' WHEN count(*) FILTER (bad) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status
  FROM (SELECT doc_id, length(unnest(string_split(text, chr(10)))) < 40 AS bad FROM documents) GROUP BY 1""")
def extract_status(t):
    bad = F.filter(F.split("text", "\n"), lambda x: F.length(x) < 40)
    n = F.size(F.split("text", "\n"))
    return t.documents.select("doc_id", F.when(F.size(bad) == n, "FAILED").when(F.size(bad) > 0, "PARTIAL").otherwise("COMPLETED").alias("status"))


@query()
def chunk_pack(t):
    """Blocks (lines) of each document packed into chunks."""
    rows = _lines(t).where(F.trim("line") != "").withColumn("kind", X.block_type(c("line"), c("line_no") == 0))
    return O.pack_blocks(rows, "doc_id", "line_no", "line", "kind").select("doc_id", "chunk", F.array_join("texts", "\n").alias("text"), "length")


@query()
def chunk_overlap_split(t):
    from ..functions.folds import overlapping_parts

    return t.documents.select("doc_id", F.posexplode(overlapping_parts("text")).alias("part", "text"))


@query(f"""WITH {_LINES}, h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-ZÀ-Ý][^.!?]*$') AND length(line) <= 120 THEN 1 + line_no % 3 END AS l FROM lines),
  n AS (SELECT doc_id, line_no, max(CASE WHEN l = 1 THEN line_no END) OVER w AS a, max(CASE WHEN l = 2 THEN line_no END) OVER w AS b, max(CASE WHEN l = 3 THEN line_no END) OVER w AS d FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT doc_id, line_no, a, CASE WHEN a IS NULL OR b > a THEN b END AS b, CASE WHEN (a IS NULL OR d > a) AND (b IS NULL OR d > b) THEN d END AS d FROM n)
  SELECT k.doc_id, k.line_no::INTEGER AS line_no, concat_ws(' > ', x.line, y.line, z.line) AS path FROM k LEFT JOIN lines x ON x.doc_id = k.doc_id AND x.line_no = a LEFT JOIN lines y ON y.doc_id = k.doc_id AND y.line_no = b LEFT JOIN lines z ON z.doc_id = k.doc_id AND z.line_no = d""")
def heading_path(t):
    """Short lines that begin with a capital and hold no sentence, as headings of three levels in turn."""
    title = c("line").rlike("^[A-ZÀ-Ý][^.!?]*$") & (F.length("line") <= 120)
    rows = _lines(t).withColumn("level", F.when(title, 1 + c("line_no") % 3))
    return O.heading_paths(rows, "doc_id", "line_no", "level", "line").select("doc_id", "line_no", F.array_join("path", " > ").alias("path"))


@query()
def span_deoverlap(t):
    words = t.documents.select("doc_id", F.posexplode(X.tokens(c("text"))).alias("i", "w"))
    spans = words.select("doc_id", (c("i") * 3).cast("long").alias("s"), (c("i") * 3 + F.length("w")).cast("long").alias("e"))
    return O.without_overlaps(spans, ["doc_id"], "s", "e", [-(c("e") - c("s")), c("s")])


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
  r AS (SELECT source, doc_id, n_chars, k, n_chars <= 60000 AS fits, CASE WHEN n_chars <= 60000 THEN n_chars ELSE 0 END AS total FROM d WHERE k = 1
   UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.k, r.total + d.n_chars <= 60000, CASE WHEN r.total + d.n_chars <= 60000 THEN r.total + d.n_chars ELSE r.total END FROM r JOIN d ON d.source = r.source AND d.k = r.k + 1)
  SELECT source, doc_id, n_chars, fits FROM r""")
def batch_admission(t):
    return O.admitted(t.documents, "source", "doc_id", "n_chars", 60000).select("source", "doc_id", "n_chars", "fits")


@query("""SELECT doc_id, sha256(nfc_normalize(text)) AS nfc FROM documents""")
def unicode_normal_forms(t):
    return t.documents.select("doc_id", F.sha2(X.normal_form("NFC")(c("text")), 256).alias("nfc"))
