"""Usage, ingestion, audit and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import issues as I
from .registry import now, query

#: Upper bounds of the histogram's buckets (fixed values).
BUCKETS = (5, 10, 25, 50, 100, 250, 500)


@query("SELECT count(*) AS n_queries, round(avg(value), 6) AS avg_latency, max(ts) AS last_query_at FROM events")
def query_totals(t):
    return A.query_statistics(t.events, "value", "ts").withColumn("avg_latency", F.round("avg_latency", 6))


@query("SELECT event_type, count(*) AS n_queries, round(avg(value), 6) AS avg_latency, max(ts) AS last_query_at FROM events GROUP BY event_type")
def query_stats_by_corpus(t):
    return A.query_statistics(t.events, "value", "ts", ["event_type"]).withColumn("avg_latency", F.round("avg_latency", 6))


@query("""SELECT source, lang, count(*) AS n_rows, coalesce(sum(n_chars), 0)::BIGINT AS sum_n_chars,
  coalesce(sum(doc_id), 0)::BIGINT AS sum_doc_id, max(doc_id) AS last_doc_id FROM documents GROUP BY source, lang""")
def ingest_status_rollup(t):
    return A.sums_or_zero(t.documents, ["n_chars", "doc_id"], ["source", "lang"], "doc_id")


@query("""WITH spine AS (SELECT strftime(DATE '2023-03-01' + INTERVAL (i) MONTH, '%Y-%m') AS period_key FROM range(12) r(i)),
  sums AS (SELECT strftime(ts, '%Y-%m') AS period_key, count(*) AS n FROM events GROUP BY 1)
  SELECT period_key, coalesce(n, 0) AS n FROM spine LEFT JOIN sums USING (period_key)""")
def monthly_usage_spine(t):
    sums = t.events.groupBy(F.date_format("ts", "yyyy-MM").alias("period_key")).agg(F.count("*").alias("n"))
    return A.on_spine(sums, A.period_spine(t.spark, "2024-02", 12), "n")


@query("""WITH both_ AS (SELECT user_id AS tenant, ts FROM events UNION ALL SELECT o_custkey, o_orderdate FROM orders)
  SELECT tenant, strftime(ts, '%Y-%m') AS period_key, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS active_hours
  FROM both_ GROUP BY 1, 2""")
def monthly_active_hours(t):
    both = t.events.select(F.col("user_id").alias("tenant"), "ts").union(t.orders.select("o_custkey", "o_orderdate"))
    return both.groupBy("tenant", F.date_format("ts", "yyyy-MM").alias("period_key")).agg(F.count("*").alias("n"), F.countDistinct(F.date_trunc("hour", "ts")).alias("active_hours"))


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) >= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_types DESC, day) AS rank FROM g)
  SELECT user_id, day, n_types, rank::INTEGER AS rank FROM r WHERE rank <= 20""")
def multi_source_users_having(t):
    rows = t.events.withColumn("day", F.to_date("ts"))
    groups = A.distinct_over(rows, ["user_id", "day"], "event_type", 2, "n_types")
    return A.top_per_group(groups, ["user_id"], [F.desc("n_types"), F.col("day")], 20)


@query("""SELECT o_orderpriority, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS n_items FROM orders GROUP BY 1""")
def distinct_items_by_status(t):
    return t.orders.groupBy("o_orderpriority").agg(F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("n_items"))


@query("""SELECT source, count(*) AS n_items, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (n_chars < 200) AS n_short,
  count(*) FILTER (n_chars > 5000) AS n_long, max(CASE WHEN lang = 'de' THEN doc_id END) AS last_de, max(n_chars) AS max_chars
  FROM documents GROUP BY source""")
def kb_metrics_one_pass(t):
    c = F.col
    return t.documents.groupBy("source").agg(F.count("*").alias("n_items"), F.count_if(c("lang") == "en").alias("n_en"), F.count_if(c("n_chars") < 200).alias("n_short"), F.count_if(c("n_chars") > 5000).alias("n_long"), F.max(F.when(c("lang") == "de", c("doc_id"))).alias("last_de"), F.max("n_chars").alias("max_chars"))


@query("SELECT o_orderpriority AS severity, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def open_issues_by_severity(t):
    return t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n_open"))


@query("""SELECT count(*) FILTER (event_type = 'view') AS n_pending, count(*) FILTER (event_type = 'click') AS n_processing,
  count(*) FILTER (event_type = 'error') AS n_failed,
  date_diff('second', min(CASE WHEN event_type = 'view' THEN ts END), TIMESTAMP '2024-01-30 00:00:00')::BIGINT AS oldest_pending_s,
  count(*) FILTER (event_type = 'click' AND ts < TIMESTAMP '2024-01-29 00:00:00') AS n_stuck, round(avg(value), 6) AS avg_attempts FROM events""")
def queue_snapshot(t):
    e, kind = t.events, F.col("event_type")
    seconds = lambda x: F.unix_seconds(x.cast("timestamp"))
    return e.agg(
        F.count_if(kind == "view").alias("n_pending"),
        F.count_if(kind == "click").alias("n_processing"),
        F.count_if(kind == "error").alias("n_failed"),
        (seconds(now()) - seconds(F.min(F.when(kind == "view", F.col("ts"))))).alias("oldest_pending_s"),
        F.count_if((kind == "click") & (F.col("ts") < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))).alias("n_stuck"),
        F.round(F.avg("value"), 6).alias("avg_attempts"),
    )


@query("""SELECT coalesce(n_name, 'ALL') AS tenant, count(*) AS n_users, round(sum(c_acctbal), 2) AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)""")
def platform_totals_rollup(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_name").agg(F.count("*").alias("n_users"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(F.coalesce("n_name", F.lit("ALL")).alias("tenant"), "n_users", "balance")


#: Rules that a row of the event table may meet, several at once.
_CANONICAL = {"activity": "event_type IN ('view', 'click')", "conversion": "event_type = 'purchase'", "high_value": "value > 200", "failure": "event_type = 'error'", "registration": "event_type = 'signup'", "suspicious": "event_type = 'error' AND value > 300", "export": "event_type = 'export'"}


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS event, count(*) FILTER ({v}) AS n FROM events" for k, v in _CANONICAL.items()) + ") SELECT event, n FROM x")
def canonical_event_counts(t):
    return A.event_counts(t.events, {k: F.expr(v) for k, v in _CANONICAL.items()})


@query("""(SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, k LIMIT 5)
  UNION ALL (SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)""")
def failed_by_key_topk(t):
    failed = t.events.where("event_type = 'error'")
    top = lambda kind, key: A.top_groups(failed, key.cast("string"), "k", 5).select(F.lit(kind).alias("kind"), "k", "n")
    return top("user", F.col("user_id")).unionByName(top("day", F.to_date("ts")))


@query("""SELECT CASE WHEN trim(source) = '' OR source IS NULL THEN 'unknown' ELSE substr(sha256(source), 1, 12) END AS source_hash, count(*) AS n
  FROM documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def hashed_top_sources(t):
    blank = F.col("source").isNull() | (F.trim("source") == "")
    return A.top_groups(t.documents, F.when(blank, "unknown").otherwise(F.substring(F.sha2("source", 256), 1, 12)), "source_hash", 10)


@query("""SELECT sha256(text) AS content_hash, array_to_string(list_sort(list(DISTINCT source)), ',') AS tenants, count(DISTINCT source) AS n_tenants
  FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 2""")
def duplicate_across_tenants(t):
    groups = t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.array_sort(F.collect_set("source")).alias("s"))  # a set of tenants, which are few
    return groups.where(F.size("s") >= 2).select("content_hash", F.array_join("s", ",").alias("tenants"), F.size("s").cast("long").alias("n_tenants"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
  SELECT user_id, count(*) AS n_recent, count(*) FILTER (event_type = 'error') AS n_errors FROM r WHERE n <= 100 GROUP BY user_id
  ORDER BY n_errors DESC, user_id LIMIT 30""")
def tenant_hotspots_capped(t):
    recent = A.top_per_group(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 100)
    return recent.groupBy("user_id").agg(F.count("*").alias("n_recent"), F.count_if(F.col("event_type") == "error").alias("n_errors")).orderBy(F.desc("n_errors"), "user_id").limit(30)


@query("""SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-29 00:00:00') AS last_day, count(*) FILTER (ts >= TIMESTAMP '2024-01-23 00:00:00') AS last_week,
  count(*) FILTER (ts >= TIMESTAMP '2023-12-31 00:00:00') AS last_month FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-30 00:00:00'""")
def signup_windows(t):
    since = lambda d: F.col("ts") >= now() - F.expr(f"interval {d} days")
    return A.conditional_counts(t.events.where(F.col("event_type") == "signup").where(F.col("ts") < now()), {"last_day": since(1), "last_week": since(7), "last_month": since(30)})


@query("""WITH x AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS n_critical, count(*) FILTER (event_type = 'click') AS n_warning FROM events GROUP BY 1)
  SELECT user_id, n_critical, n_warning, CASE WHEN n_critical >= 15 THEN 'high' WHEN n_critical >= 5 OR n_warning >= 25 THEN 'medium' ELSE 'low' END AS risk FROM x""")
def risk_assessment(t):
    kind = F.col("event_type")
    x = A.conditional_counts(t.events, {"n_critical": kind == "error", "n_warning": kind == "click"}, ["user_id"])
    return x.withColumn("risk", F.when(F.col("n_critical") >= 15, "high").when((F.col("n_critical") >= 5) | (F.col("n_warning") >= 25), "medium").otherwise("low"))


@query("""WITH v AS (SELECT count(*) FILTER (event_type = 'error') AS errors, 100.0 * count(*) FILTER (event_type = 'error') / count(*) AS error_share, max(value) AS slowest, count(DISTINCT user_id) AS users FROM events),
  r AS (SELECT 'errors' AS rule, errors::DOUBLE AS value, 1000.0::DOUBLE AS threshold FROM v UNION ALL SELECT 'error_share', round(error_share::DOUBLE, 6), 2.0 FROM v
   UNION ALL SELECT 'slowest', slowest, 1500.0 FROM v UNION ALL SELECT 'users', users::DOUBLE, 100.0 FROM v UNION ALL SELECT 'p95', slowest, NULL FROM v)
  SELECT rule, value, threshold, CASE WHEN threshold IS NULL OR value IS NULL THEN 'unavailable' WHEN value > threshold THEN 'triggered' ELSE 'ok' END AS state FROM r""")
def alert_rules(t):
    failed = F.count_if(F.col("event_type") == "error")
    v = t.events.agg(failed.alias("errors"), F.round(100.0 * failed / F.count("*"), 6).alias("error_share"), F.max("value").alias("slowest"), F.countDistinct("user_id").alias("users"))
    return A.alert_rules(v, [("errors", "errors", 1000.0), ("error_share", "error_share", 2.0), ("slowest", "slowest", 1500.0), ("users", "users", 100.0), ("p95", "slowest", None)])


@query("""SELECT user_id, count(*) AS requests, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS avg_ok_ms,
  count(*) FILTER (event_type = 'purchase') AS helpful, count(*) FILTER (event_type = 'error') AS not_helpful FROM events GROUP BY 1""")
def channel_analytics(t):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.count("*").alias("requests"), F.round(F.avg(F.when(kind != "error", F.col("value"))), 6).alias("avg_ok_ms"), F.count_if(kind == "purchase").alias("helpful"), F.count_if(kind == "error").alias("not_helpful"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
  SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, max(CASE WHEN n = 1 THEN value END) AS last,
  round(quantile_cont(value, 0.5) FILTER (n <= 2048), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (n <= 2048), 6) AS p95, round(quantile_cont(value, 0.99) FILTER (n <= 2048), 6) AS p99
  FROM r GROUP BY event_type""")
def metric_quantiles(t):
    out = A.metric_series(t.events, ["event_type"], "value", "ts", "event_id")
    return out.withColumns({"total": F.round("total", 4)} | {p: F.round(p, 6) for p in ("p50", "p95", "p99")})


@query("SELECT event_type, le, n FROM (" + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY 1" for b in BUCKETS) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY 1)")
def metric_histogram(t):
    return A.cumulative_histogram(t.events, "value", BUCKETS, ["event_type"])


@query("SELECT 'request_ms_bucket{event_type=\"' || event_type || '\",le=\"' || le || '\"} ' || n AS line FROM (" + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY 1" for b in BUCKETS) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY 1)")
def prometheus_exposition(t):
    return A.prometheus_lines(A.cumulative_histogram(t.events, "value", BUCKETS, ["event_type"]), "request_ms", "event_type")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, value, value > 250 AS occ, struct_pack(a := ts, b := event_id) AS at_, CASE event_id % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'IGNORED' ELSE 'ACKNOWLEDGED' END AS st FROM events),
  o AS (SELECT user_id, event_type, min(at_) AS first_, max(at_) AS last_, count(*) AS n, arg_max(CASE WHEN value > 400 THEN 'error' ELSE 'warning' END, at_) AS severity, arg_max('event ' || event_id, at_) FILTER (event_id % 4 > 0) AS message, arg_max(props_k, at_) AS k FROM (SELECT * FROM e JOIN (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS props_k FROM events) USING (event_id)) WHERE occ GROUP BY 1, 2),
  u AS (SELECT e.user_id, e.event_type, max(at_) AS set_, arg_max(st, at_) AS st FROM e JOIN o USING (user_id, event_type) WHERE NOT occ AND at_ > first_ GROUP BY 1, 2),
  m AS (SELECT user_id, event_type, event_id % 3 AS r, arg_max(event_id, at_) AS id FROM e WHERE occ GROUP BY 1, 2, 3), g AS (SELECT user_id, event_type, string_agg('"u' || r || '":{"id":' || id || '}', ',' ORDER BY r) AS us FROM m GROUP BY 1, 2),
  w AS (SELECT *, coalesce(set_ > last_, false) AS after FROM o LEFT JOIN u USING (user_id, event_type) JOIN g USING (user_id, event_type))
  SELECT user_id, event_type, n AS occurrence_count, first_.a AS first_seen_at, last_.a AS last_seen_at, severity, message, CASE WHEN st IS NULL OR (NOT after AND st <> 'ACKNOWLEDGED') THEN 'OPEN' ELSE st END AS status,
  CASE WHEN after AND st <> 'ACKNOWLEDGED' THEN set_.a END AS resolved_at, '{"k":' || k || ',' || us || '}' AS metadata FROM w""")
def issue_upsert(t):
    """The issues of half a month are the stored table into which those of the other half are upserted."""
    c, occurs = F.col, F.col("value") > 250
    status = F.when(c("event_id") % 3 == 0, "RESOLVED").when(c("event_id") % 3 == 1, "IGNORED").otherwise("ACKNOWLEDGED")
    metadata = F.format_string('{"k":%s,"u%d":{"id":%d}}', F.regexp_extract("props", "([0-9]+)", 1), c("event_id") % 3, c("event_id"))
    rows = t.events.select("user_id", "event_type", "ts", c("event_id").alias("order"), F.when(~occurs, status).alias("status"), F.when(c("value") > 400, "error").otherwise("warning").alias("severity"), F.when(c("event_id") % 4 > 0, F.concat(F.lit("event "), c("event_id"))).alias("message"), F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("string").alias("step"), metadata.alias("metadata"))
    half, key = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), ["user_id", "event_type"]
    stored = I.upsert_issues(None, rows.where(c("ts") < half), key)
    return I.upsert_issues(stored, rows.where(c("ts") >= half), key).drop("job_id", "step")


@query("""WITH x AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 100) AS failed FROM documents GROUP BY 1)
  SELECT source, n, failed, round(failed::DOUBLE / n, 4) AS failure_ratio, CASE WHEN failed::DOUBLE / n > 0.5 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM x""")
def embedding_status_counts(t):
    x = A.conditional_counts(t.documents, {"n": F.lit(True), "failed": F.col("n_chars") < 100}, ["source"])
    ratio = F.col("failed") / F.col("n")
    return x.select("source", "n", "failed", F.round(ratio, 4).alias("failure_ratio"), F.when(ratio > 0.5, "FAILED").when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETED").alias("status"))


@query("""SELECT d.source AS batch, count(*) AS n_items, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS pending,
  min(d.doc_id) AS first_item, max(d.doc_id) AS last_item, sum(n_chars)::BIGINT AS characters, count(*) > 45 AS has_more FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def ingest_run_list(t):
    q = F.col("quality")
    return t.documents.join(t.labels, "doc_id", "left").groupBy(F.col("source").alias("batch")).agg(F.count("*").alias("n_items"), F.count_if(q == 1).alias("accepted"), F.count_if(q == 0).alias("failed"), F.count_if(q.isNull()).alias("pending"), F.min("doc_id").alias("first_item"), F.max("doc_id").alias("last_item"), F.sum("n_chars").alias("characters"), (F.count("*") > 45).alias("has_more"))


@query("""WITH v AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS e, max(ts) AS m FROM events)
  SELECT 'events_present' AS check_name, n > 0 AS passed FROM v UNION ALL SELECT 'errors_below_share', e < 0.25 * n FROM v UNION ALL SELECT 'recent', m >= TIMESTAMP '2024-01-29 00:00:00' FROM v""")
def readiness_checklist(t):
    v = t.events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.max("ts").alias("m"))
    row = lambda name, c: F.struct(F.lit(name).alias("check_name"), c.alias("passed"))
    checks = F.array(row("events_present", F.col("n") > 0), row("errors_below_share", F.col("e") < 0.25 * F.col("n")), row("recent", F.col("m") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")))
    return v.select(F.explode(checks).alias("x")).select("x.*")


@query("SELECT lower(trim(o_orderpriority)) AS email, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def completed_signups(t):
    return t.orders.where("o_orderstatus = 'F'").groupBy(F.lower(F.trim("o_orderpriority")).alias("email")).agg(F.count("*").alias("n"))


@query("SELECT lang, median(n_chars)::DOUBLE AS median_chars FROM documents GROUP BY lang")
def median_baseline(t):
    return t.documents.groupBy("lang").agg(F.median("n_chars").alias("median_chars"))


@query("SELECT source, (max(doc_id) + 1)::BIGINT AS next_version FROM documents GROUP BY source")
def next_version(t):
    return t.documents.groupBy("source").agg((F.max("doc_id") + 1).alias("next_version"))
