"""The queries of the training-data operators, one for each, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, clusterlayout, decontaminate, htmltext, maxent, mixing, quality, sharding, simhash, urlrules, vectorcodes
from .common import id_fold


#: What both turns of conversation -1 say, and the rules of the URL query.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fingerprint_bits")).alias("fingerprint"), "component_id")


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_read(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlrules.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = clusterlayout.document_layout(_read(spark, sf_dir, "documents"))
    bounds = F.concat_ws(",", *[F.col(f"{e}{i}").cast("string") for i in range(4) for e in ("low", "high")])
    return laid.select("doc_id", "z", "position", "file", "files_touched", "files_matching", bounds.alias("file_bounds"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    found = bpe.decode(encoded, path)
    tokens = F.expr("octet_length(ids) div 4").cast("long")
    return found.select("doc_id", tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcodes.encode(_read(spark, sf_dir, "embeddings"))
    found = vectorcodes.label_errors(codes)
    return found.select(F.col("__id").alias("vec_id"), vectorcodes.code_text(F.col("code")).alias("code"), "error", "label_error", F.lit(vectorcodes.books_digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_quality, op2_decontamination, op3_simhash, op4_maxent, op5_chat, op6_urls, op7_ann, op8_mixing, op9_sharding, op10_html, op11_layout, op12_bpe, op13_codes)}


def _escaped(x: str) -> str:
    """Control strings of a text escaped, in SQL."""
    out = rf"replace({x}, '\', '\\')"
    for mark in chat.Template().foreign:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_T = chat.Template()
_CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
  m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t),
  g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
   coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
   sum(length({_escaped("text")}) + CASE WHEN before = role THEN {len(_T.part)} ELSE {len(_T.start + _T.head_end + _T.end + _T.after)} + length({_escaped("role")}) END)::BIGINT AS formatted_chars FROM m GROUP BY conv_id)
  SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g"""

_FITS = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for h, p, v in RULES)
_AFTER = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_URLS = f"""WITH r AS ({_FITS}), u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, {_AFTER} AS rest FROM pages)),
  f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict FROM u JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
  SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)"""

_MIX = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1), w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
  l AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, struct_pack(a := ratio, b := coalesce(source, ''))) FROM l WHERE level <= ratio) * weight), cap) AS target FROM l),
  q AS (SELECT d.*, source_size, target, (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
  SELECT doc_id, size, source_size, target, (size * (CASE WHEN target > 0 AND (before + size) / target + (0 - size / 2.0::DOUBLE) / target <= 1.0 THEN 1 ELSE 0 END + CASE WHEN target > 0 AND (before + size) / target + (source_size - size / 2.0::DOUBLE) / target <= 1.0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM q"""


_CRC = "xor(4294967295, list_reduce(list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1))::BIGINT), lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)), xor(c, b)), 4294967295::BIGINT))"
_AXES = ("source", "lang", "length", "date")
_LAYOUT = f"""WITH v AS (SELECT doc_id, source, lang, coalesce(strlen(text), -1)::BIGINT AS length, ({_CRC.replace("(t", "(doc_id::VARCHAR")}) % 365 AS date FROM documents),
  c AS (SELECT doc_id, {", ".join(f"(16 * (rank() OVER (ORDER BY {a} NULLS FIRST) - 1)) // (count(*) OVER ()) AS c{i}" for i, a in enumerate(_AXES))} FROM v),
  z AS (SELECT *, {" + ".join(f"((c{i} >> {b}) & 1) * {1 << (4 * b + 3 - i)}" for b in range(4) for i in range(4))} AS z FROM c),
  p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM z), f AS (SELECT *, position // 1000 AS file FROM p),
  b AS MATERIALIZED (SELECT file, {", ".join(f"min(c{i}) AS l{i}, max(c{i}) AS h{i}" for i in range(4))} FROM f GROUP BY file), q AS MATERIALIZED (SELECT DISTINCT c0, c1, c2, c3 FROM f), m AS MATERIALIZED (SELECT DISTINCT file, c0, c1, c2, c3 FROM f),
  t AS (SELECT q.c0, q.c1, q.c2, q.c3, count(*) AS files_touched FROM q JOIN b ON q.c0 BETWEEN l0 AND h0 AND q.c1 BETWEEN l1 AND h1 AND h2 >= q.c2 - 2 AND l2 <= q.c2 + 2 AND h3 >= q.c3 - 2 AND l3 <= q.c3 + 2 GROUP BY ALL),
  x AS (SELECT q.c0, q.c1, q.c2, q.c3, count(DISTINCT m.file) AS files_matching FROM q JOIN m ON q.c0 = m.c0 AND q.c1 = m.c1 AND abs(q.c2 - m.c2) <= 2 AND abs(q.c3 - m.c3) <= 2 GROUP BY ALL)
  SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, files_touched::BIGINT AS files_touched, files_matching::BIGINT AS files_matching, concat_ws(',', l0, h0, l1, h1, l2, h2, l3, h3) AS file_bounds FROM f JOIN b USING (file) JOIN t USING (c0, c1, c2, c3) JOIN x USING (c0, c1, c2, c3)"""


def _codes_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds unrolled; all numbers are whole and below 2**53, so doubles hold them exactly."""
    sums = ", ".join(f"floor(sum(x[{i}]) / count(*))" for i in range(1, width + 1))
    square = " + ".join(f"(x[{i}] - b.e[{i}]) * (x[{i}] - b.e[{i}])" for i in range(1, width + 1))
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS r FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS MATERIALIZED (SELECT r, part, v[part * {width} + 1 : (part + 1) * {width}] AS x FROM v, (SELECT unnest(range({parts})) AS part)), b0 AS MATERIALIZED (SELECT part, r - 1 AS j, x AS e FROM p WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p.part, min(struct_pack(d := {square}, j := b.j)) AS m FROM p JOIN b{k} AS b ON p.part = b.part GROUP BY ALL)")
        if k < rounds:
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.j, coalesce(n.e, b.e) AS e FROM b{k} AS b LEFT JOIN (SELECT a.part, m.j AS j, [{sums}] AS e FROM a{k} AS a JOIN p USING (r, part) GROUP BY ALL) AS n ON b.part = n.part AND b.j = n.j)")
    return "WITH " + ", ".join(steps) + f""", h AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda c: c::BIGINT), ','), ',' ORDER BY part, j)) AS codebooks_sha256 FROM b{rounds}),
  c AS (SELECT r, string_agg(lower(lpad(to_hex(m.j), 2, '0')), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (r), h"""


def oracle_sql() -> dict[str, str]:
    return {"op13_codes": _codes_sql(), "op11_layout": _LAYOUT, "op5_chat": _CHAT, "op6_urls": _URLS, "op8_mixing": _MIX}
