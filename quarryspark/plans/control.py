"""Queues, alerts, limits, masks and index upkeep."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import billing as B
from ..functions import text as X
from ..operators import control as O
from ..operators import joins as J
from ..operators import knowledge as K
from ..operators.aggregates import conditional_counts
from .registry import NOW, now, query

c = F.col
_AT = f"TIMESTAMP '{NOW}'"
_KINDS = {"signup": "security.audit_event", "purchase": "email.notification", "view": "knowledge.index_build", "click": "url.fetch"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE 'other' END"


def _kind():
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), c("event_type")), F.lit("other"))


@query("""WITH k AS (SELECT event_id, ts, value, ts < TIMESTAMP '2024-01-15 00:00:00' AS old, 'security:' || CASE WHEN value > 250 THEN 'high' ELSE 'low' END || ':' || event_type || '-' || user_id % 10 AS alert_key FROM events)
  SELECT alert_key, arg_max(value, struct_pack(a := ts, b := event_id)) AS value, count(*) AS hit_count, CASE WHEN bool_or(NOT old) THEN 'open' ELSE 'acknowledged' END AS status, min(ts) AS first_seen_at, max(ts) AS last_seen_at,
   CASE WHEN bool_or(NOT old) THEN NULL ELSE max(ts) END AS acknowledged_at FROM k GROUP BY 1""")
def alert_upsert(t):
    """Alerts of the first half of the month, acknowledged, take up the signals of the second."""
    key = O.alert_key(F.lit("security"), F.when(c("value") > 250, "High ").otherwise("low"), F.concat_ws("-", c("event_type"), c("user_id") % 10))
    rows = t.events.select("event_id", "ts", "value", key.alias("alert_key"))
    half = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    first = rows.where(c("ts") < half).groupBy("alert_key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("hit_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
    old = first.withColumns({"status": F.lit("acknowledged"), "acknowledged_at": c("last_seen_at")})
    return O.upsert_alerts(old, rows.where(c("ts") >= half), "ts", "event_id")


@query("""WITH w AS (SELECT o_orderpriority, count(*) AS waiting FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
  n AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')
  SELECT o_orderkey, n <= greatest(0, 700 - coalesce(waiting, 0)) AS accepted FROM n LEFT JOIN w USING (o_orderpriority)""")
def backlog_admission(t):
    waiting = t.orders.where("o_orderstatus = 'P'").groupBy("o_orderpriority").agg(F.count("*").alias("waiting"))
    new = t.orders.where("o_orderstatus = 'O'")
    return O.within_backlog(new, waiting, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 700).select("o_orderkey", "accepted")


@query(f"""WITH j AS (SELECT event_id, {_KIND} AS kind, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'running' END AS status, ts AS locked_at, ts + INTERVAL (event_id % 50) MINUTE AS beat_at FROM events),
  p AS (SELECT *, CASE kind WHEN 'security.audit_event' THEN 15 WHEN 'email.notification' THEN 30 WHEN 'knowledge.index_build' THEN 3600 WHEN 'url.fetch' THEN 120 ELSE 20 END AS timeout_s,
   CASE kind WHEN 'security.audit_event' THEN 60 WHEN 'email.notification' THEN 120 WHEN 'knowledge.index_build' THEN 3900 WHEN 'url.fetch' THEN 180 ELSE 300 END AS lease_s,
   CASE kind WHEN 'security.audit_event' THEN 10 WHEN 'email.notification' THEN 15 WHEN 'knowledge.index_build' THEN 60 WHEN 'url.fetch' THEN 15 ELSE 30 END AS heartbeat_s FROM j)
  SELECT event_id, kind, timeout_s, lease_s, heartbeat_s, CASE WHEN status <> 'running' THEN 'keep' WHEN epoch({_AT}) - epoch(greatest(locked_at, beat_at)) > lease_s THEN 'recover' WHEN epoch({_AT}) - epoch(locked_at) > timeout_s THEN 'time_out' ELSE 'heartbeat' END AS action FROM p""")
def lease_recovery(t):
    jobs = t.events.select("event_id", _kind().alias("kind"), F.when(c("event_id") % 3 == 0, "done").otherwise("running").alias("status"), c("ts").alias("locked_at"), (c("ts") + F.make_dt_interval(mins=(c("event_id") % 50).cast("int"))).alias("beat_at"))
    rows = O.recovered(jobs, "status", c("kind"), "locked_at", "beat_at", now(), 20)
    return rows.withColumn("p", O.event_policy(c("kind"), 20)).select("event_id", "kind", "p.*", "action")


@query("""WITH e AS (SELECT user_id, ['understanding', 'discovery', 'embedding', 'indexing'][(event_id % 4)::INTEGER + 1] AS stage, CASE WHEN value > 400 THEN 'failed' WHEN value > 60 THEN 'completed' ELSE 'started' END AS status, ts, event_id FROM events),
  n AS (SELECT user_id, stage, arg_max(status, struct_pack(a := ts, b := event_id)) AS s FROM e GROUP BY 1, 2),
  w AS (SELECT user_id, max(s) FILTER (stage = 'understanding') AS a, max(s) FILTER (stage = 'discovery') AS b, max(s) FILTER (stage = 'embedding') AS c, max(s) FILTER (stage = 'indexing') AS d FROM n GROUP BY 1),
  k AS (SELECT *, CASE WHEN coalesce(a, '') <> 'completed' THEN 0 WHEN coalesce(b, '') <> 'completed' THEN 1 WHEN coalesce(c, '') <> 'completed' THEN 2 WHEN coalesce(d, '') <> 'completed' THEN 3 ELSE 4 END AS n_done FROM w)
  SELECT user_id, n_done, (['understanding', 'discovery', 'embedding', 'indexing', NULL])[n_done + 1] AS next_stage, CASE WHEN n_done = 4 THEN 'done' WHEN ([a, b, c, d])[n_done + 1] = 'failed' THEN 'failed' WHEN ([a, b, c, d])[n_done + 1] IS NULL THEN 'due' ELSE 'running' END AS state FROM k""")
def stage_chain(t):
    stage = F.element_at(F.array(*[F.lit(s) for s in O.STAGES]), (c("event_id") % 4 + 1).cast("int"))
    status = F.when(c("value") > 400, "failed").when(c("value") > 60, "completed").otherwise("started")
    return O.next_stage(t.events.select("user_id", stage.alias("stage"), status.alias("status"), "ts", "event_id"), "user_id", "stage", "status", ["ts", "event_id"])


@query("""SELECT c_custkey, s.scope, CASE s.scope WHEN 'demo' THEN 1024 ELSE 2400 END AS max_question_chars, CASE s.scope WHEN 'demo' THEN 3 WHEN 'starter' THEN 5 ELSE 8 END AS max_sources, CASE s.scope WHEN 'demo' THEN 10 ELSE 120 END AS minute_cap
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'demo' WHEN c_mktsegment = 'BUILDING' THEN 'starter' ELSE 'default' END AS scope FROM customer) s""")
def plan_chat_limits(t):
    package = F.when(c("c_mktsegment") == "BUILDING", " Starter").otherwise(c("c_mktsegment"))
    rows = t.customer.select("c_custkey", O.chat_limits(package, c("c_custkey") % 9 == 0).alias("l"))
    return rows.select("c_custkey", "l.scope", "l.max_question_chars", "l.max_sources", "l.minute_cap")


@query("""WITH x AS (SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, floor(value) / 500 - 0.05::DOUBLE)) AS v, event_id % 5 AS hits, event_id % 7 = 0 AS a FROM events), y AS (SELECT *, CASE WHEN hits > 1 THEN least(1.0::DOUBLE, v + 0.05::DOUBLE * (hits - 1)) ELSE v END AS w FROM x)
  SELECT event_id, round_even(CASE WHEN a THEN w * 0.5::DOUBLE ELSE w END, 4) AS confidence FROM y""")
def candidate_confidence(t):
    score = O.confidence(F.floor("value") / 500 - 0.05, c("event_id") % 5, c("event_id") % 7 == 0)
    return t.events.select("event_id", score.alias("confidence"))


@query("""SELECT event_id, event_type, value / 500 AS score FROM events WHERE event_type NOT IN ('purchase', 'view') OR (event_type = 'purchase' AND value / 500 >= 0.5::DOUBLE) OR (event_type = 'view' AND value / 500 >= 0.25::DOUBLE)""")
def confidence_gate(t):
    rows = t.events.select("event_id", "event_type", (c("value") / 500).alias("score"))
    return O.confident(rows, "event_type", "score", {"purchase": 0.5, "view": 0.25})


@query("""WITH s AS (SELECT vec_id, label AS v FROM embeddings WHERE vec_id % 3 <> 0), w AS (SELECT doc_id, (n_chars % 10)::INTEGER AS v FROM documents)
  SELECT coalesce(vec_id, doc_id) AS point, CASE WHEN doc_id IS NULL THEN 'delete' WHEN vec_id IS NULL THEN 'insert' WHEN s.v <> w.v THEN 'replace' ELSE 'keep' END AS change FROM s FULL JOIN w ON vec_id = doc_id""")
def index_rebuild_changes(t):
    stored = t.embeddings.where("vec_id % 3 <> 0").select(c("vec_id").alias("point"), c("label").alias("v"))
    return O.index_changes(stored, t.documents.select(c("doc_id").alias("point"), (c("n_chars") % 10).cast("int").alias("v")), "point", "v")


@query("""WITH s AS (SELECT vec_id, label AS v FROM embeddings WHERE vec_id % 3 <> 0), w AS (SELECT doc_id, source, (n_chars % 10)::INTEGER AS v FROM documents), j AS (SELECT source, vec_id IS NULL OR s.v <> w.v AS todo, n_bad FROM w LEFT JOIN s ON vec_id = doc_id LEFT JOIN (SELECT doc_id AS b, 1 AS n_bad FROM labels WHERE quality = 0) ON b = doc_id)
  SELECT source, count(*) AS items, count(*) FILTER (todo) AS changed, count(n_bad) FILTER (todo) AS failed, CASE WHEN count(*) FILTER (todo) <= 0 OR count(n_bad) FILTER (todo) >= count(*) THEN 'failed' WHEN count(n_bad) FILTER (todo) > 0 THEN 'partial' ELSE 'completed' END AS status FROM j GROUP BY 1""")
def rebuild_orchestration(t):
    """A rebuild by source: what it changes, what of that fails, and the status that follows."""
    from ..functions.questions import rebuild_status

    stored = t.embeddings.where("vec_id % 3 <> 0").select(c("vec_id").alias("doc_id"), c("label").alias("v"))
    changes = O.index_changes(stored, t.documents.select("doc_id", (c("n_chars") % 10).cast("int").alias("v")), "doc_id", "v").where("change <> 'delete'")
    rows = changes.join(t.documents.select("doc_id", "source"), "doc_id").join(t.labels.where("quality = 0").select("doc_id", "quality"), "doc_id", "left")
    todo = c("change") != "keep"
    x = conditional_counts(rows, {"items": F.lit(True), "changed": todo, "failed": todo & c("quality").isNotNull()}, ["source"])
    return x.withColumn("status", rebuild_status(c("items"), c("failed"), c("changed"), c("changed") - c("failed"), F.lit(False)))


@query("""WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
  SELECT user_id, CASE WHEN contains(m, '@') THEN substr(m, 1, 2) || repeat('*', length(split_part(m, '@', 1)) - 2) || '@' || repeat('*', length(split_part(m, '@', 2)) - 5) || right(m, 5) ELSE '[REDACTED]' END AS masked
  FROM (SELECT user_id, CASE WHEN user_id % 6 = 0 THEN 'nobody' ELSE 'user' || user_id || '@mail' || n || '.example.com' END AS m FROM e)""")
def email_log_mask(t):
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", X.mask_email_for_log(F.when(c("user_id") % 6 == 0, "nobody").otherwise(F.format_string("user%d@mail%d.example.com", c("user_id"), c("n")))).alias("masked"))


@query("""SELECT c_custkey, f.masked FROM (SELECT c_custkey, lower(c_mktsegment) || '@x.example' AS mail, CASE c_custkey % 4 WHEN 0 THEN sha256(lower(c_mktsegment) || '@x.example') WHEN 1 THEN substr(lower(c_mktsegment), 1, 1) || repeat('*', length(c_mktsegment) - 1) || '@x.example' WHEN 2 THEN 'by ' || lower(c_mktsegment) || '@x.example' ELSE 'none' END AS masked FROM customer) f
  WHERE f.mail ILIKE '%building%' AND c_custkey % 4 <> 3 AND mail = 'building@x.example'""")
def email_variants_filter(t):
    """Rows whose details hold an address, its hash or its mask."""
    mail = F.concat(F.lower("c_mktsegment"), F.lit("@x.example"))
    details = F.when(c("c_custkey") % 4 == 0, F.sha2(mail, 256)).when(c("c_custkey") % 4 == 1, X.mask_email(mail)).when(c("c_custkey") % 4 == 2, F.concat(F.lit("by "), mail)).otherwise("none")
    return t.customer.select("c_custkey", details.alias("masked")).where(X.names_address(c("masked"), "building@x.example"))


@query("""SELECT event_id, TRY_CAST(nullif(json_extract_string(props, '$.k'), '') AS BIGINT) AS as_long, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS as_flag, CASE WHEN event_id % 2 = 0 THEN ts END AS as_time FROM events""")
def json_casts(t):
    d = F.to_json(F.struct(F.when(c("event_id") % 3 == 0, "").when(c("event_id") % 3 == 1, "true").otherwise("false").alias("flag"), F.when(c("event_id") % 2 == 0, c("ts").cast("string")).otherwise("soon").alias("at")))
    rows = t.events.withColumn("d", d)
    return rows.select("event_id", X.json_as(c("props"), "$.k", "bigint").alias("as_long"), X.json_as(c("d"), "$.flag", "boolean").alias("as_flag"), X.json_as(c("d"), "$.at", "timestamp_ntz").alias("as_time"))


@query("""WITH p AS (SELECT o_orderkey, o_totalprice::BIGINT % 9000 AS old, o_totalprice::BIGINT % 12000 AS new, DATE '2024-01-01' AS a, DATE '2024-01-31' AS b, DATE '2023-12-25' + (o_orderkey % 45)::INTEGER AS d FROM orders),
  q AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (date_diff('day', d, b) + 1) / 31.0::DOUBLE)) AS share FROM p)
  SELECT o_orderkey, round(share, 6) AS share, greatest(0, round_even((new - old) * share, 0))::BIGINT AS charge FROM q""")
def upgrade_charges(t):
    day = lambda x: F.lit(x).cast("date")
    share = B.proration(day("2024-01-01"), day("2024-01-31"), F.date_add(day("2023-12-25"), (c("o_orderkey") % 45).cast("int")))
    price = F.round("o_totalprice").cast("long")
    return t.orders.select("o_orderkey", F.round(share, 6).alias("share"), B.upgrade_charge(price % 9000, price % 12000, share).alias("charge"))


@query("""WITH x AS (SELECT c.c_custkey, n_nationkey, coalesce(o.n, 0) AS n, coalesce(o.d, 0) AS d, coalesce(o.s, 0) AS s FROM customer c JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS d, sum(o_totalprice) AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey)
  SELECT c_custkey, concat_ws(',', CASE WHEN n > 12 THEN 'users' END, CASE WHEN d > 4 THEN 'knowledge_bases' END, CASE WHEN n_nationkey > 20 THEN 'questions' END, CASE WHEN s > 2000000 THEN 'characters' END) AS over FROM x""")
def plan_limit_checks(t):
    o = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("d"), F.sum("o_totalprice").alias("s"))
    rows = t.customer.join(o, "c_custkey", "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    over = B.limits_exceeded({"users": (zero("n"), F.lit(12)), "knowledge_bases": (zero("d"), F.lit(4)), "questions": (c("c_nationkey"), F.lit(20)), "characters": (zero("s"), F.lit(2_000_000))})
    return rows.select("c_custkey", F.array_join(over, ",").alias("over"))


# The alert rules. Rule, priority, measure (none: unavailable), threshold (none: not stated), and how the
# measure triggers: "least" from the threshold on, "most" up to below it, "over" above it, "any" above zero;
# and a second measure with the least that it needs.
_RULES = (
    ("p1_api_not_responding", "P1", "requests", 1, "most", None),
    ("p1_db_unreachable", "P1", "db_errors", 1, "least", None),
    ("p1_login_outage", "P1", "failed_logins", 20, "least", ("no_logins", 1)),
    ("p1_payment_outage", "P1", None, None, "least", None),
    ("p1_disk_usage_high", "P1", None, None, "least", None),
    ("p1_restart_loop", "P1", None, None, "least", None),
    ("p1_failed_login_same_ip", "P1", "most_by_ip", 10, "least", None),
    ("p1_failed_login_same_email", "P1", "most_by_mail", 20, "least", None),
    ("p1_admin_login_new_country_ip", "P1", "new_ips", 1, "least", None),
    ("p1_privilege_escalation", "P1", "escalations", 1, "least", None),
    ("p1_permission_denied_spike", "P1", "denied", 15, "least", None),
    ("p1_rate_limit_spike", "P1", "limited", 50, "least", None),
    ("p1_token_abuse", "P1", "bad_tokens", 20, "least", None),
    ("p2_api_latency_p95", "P2", None, None, "least", None),
    ("p2_error_rate", "P2", "error_share", 2, "over", ("requests", 100)),
    ("p2_db_slow_query_spike", "P2", None, None, "least", None),
    ("p2_queue_failure_rise", "P2", "queue_failures", 5, "least", None),
    ("p2_payment_failed_rise", "P2", None, None, "least", None),
    ("p2_new_device_login_rise", "P2", "new_devices", 10, "least", None),
    ("p3_deployment_finished", "P3", "deployments", None, "any", None),
    ("p3_new_admin_created", "P3", "new_admins", None, "any", None),
    ("p3_feature_flag_changed", "P3", None, None, "least", None),
    ("p3_usage_spike", "P3", "requests", 1000, "least", None),
    ("p3_export_completed", "P3", "exports", None, "any", None),
)
#: What stands for each measure in the events: (event type, least value), counted.
_MEASURES = {"requests": (None, 0), "db_errors": ("error", 489), "failed_logins": ("error", 300), "logins": ("view", 489.99), "escalations": ("error", 489.9), "denied": ("click", 480), "limited": ("click", 470), "bad_tokens": ("view", 486), "queue_failures": ("purchase", 485), "new_devices": ("signup", 485), "deployments": ("signup", 489.5), "new_admins": ("signup", 400), "exports": ("purchase", 489)}
_COUNTED = ", ".join(f"count(*) FILTER ({f'event_type = {chr(39)}{k}{chr(39)} AND ' if k else ''}value >= {v})::DOUBLE AS {n}" for n, (k, v) in _MEASURES.items())
_HITS = {"least": "value >= threshold", "most": "value < threshold", "over": "value > threshold", "any": "value > 0"}
_RULE_ROWS = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{p}' AS priority, {m or 'NULL'}::DOUBLE AS value, {t if t is not None else 'NULL'}::DOUBLE AS threshold, '{how}' AS how, {f'{also[0]} >= {also[1]}' if also else 'true'} AS also FROM m" for r, p, m, t, how, also in _RULES)


@query(f"""WITH a AS (SELECT {_COUNTED}, round(100.0::DOUBLE * count(*) FILTER (event_type = 'error' AND value > 400) / count(*), 2) AS error_share FROM events),
  b AS (SELECT max(n)::DOUBLE AS most_by_ip FROM (SELECT count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id)), d AS (SELECT max(n)::DOUBLE AS most_by_mail FROM (SELECT count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id % 40)),
  i AS (SELECT count(*)::DOUBLE AS new_ips FROM (SELECT DISTINCT user_id FROM events WHERE ts >= {_AT} - INTERVAL 1 DAY AND event_type = 'signup' EXCEPT SELECT user_id FROM events WHERE ts < {_AT} - INTERVAL 1 DAY AND event_type = 'signup')),
  m AS (SELECT *, CASE WHEN logins = 0 THEN 1 ELSE 0 END AS no_logins FROM a, b, d, i), r AS ({_RULE_ROWS})
  SELECT rule, priority, value, threshold, CASE WHEN value IS NULL THEN 'unavailable' WHEN also AND CASE how {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _HITS.items())} END THEN 'triggered' ELSE 'ok' END AS status FROM r""")
def alert_rule_table(t):
    """All alert rules as rows over one pass of conditional counts and three small ones."""
    e = t.events
    counted = {n: F.count_if((c("event_type") == k if k else F.lit(True)) & (c("value") >= v)).cast("double") for n, (k, v) in _MEASURES.items()}
    a = e.agg(*[x.alias(n) for n, x in counted.items()], F.round(100.0 * F.count_if((c("event_type") == "error") & (c("value") > 400)) / F.count("*"), 2).alias("error_share"))
    a = a.withColumn("no_logins", (c("logins") == 0).cast("int"))
    most = lambda by, name: e.where("event_type = 'error'").groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n").cast("double").alias(name))
    day, signups = now() - F.expr("interval 1 day"), e.where("event_type = 'signup'")
    new = J.only_new(signups.where(c("ts") >= day), signups.where(c("ts") < day), ["user_id"]).agg(F.count("*").cast("double").alias("new_ips"))
    return K.rule_rows([a, most(c("user_id"), "most_by_ip"), most(c("user_id") % 40, "most_by_mail"), new], _RULES)


@query("""SELECT doc_id, CASE WHEN length(text) > 50000 THEN 'PART_TOO_LONG' WHEN strlen(text) > 100000 THEN 'TOO_LARGE' WHEN len(string_split(text, chr(10))) > 500 THEN 'TOO_MANY_PAGES' WHEN len(string_split(text, ' ')) > 15000 THEN 'TOO_MANY_PARTS' WHEN n_chars / 20 > 600 THEN 'TIMEOUT' END AS error FROM documents""")
def extract_limit_ladder(t):
    lines, words = F.size(F.split("text", "\n")), F.size(F.split("text", " "))
    error = X.extract_error(F.octet_length("text"), lines, words, F.length("text"), c("n_chars") / 20, most_bytes=100_000, most_parts=15_000)
    return t.documents.select("doc_id", error.alias("error"))


@query("""WITH x AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 100) AS bad, bool_or(n_chars > 18000) AS late FROM documents GROUP BY 1) SELECT source, CASE WHEN bad = n THEN 'FAILED' WHEN late THEN 'PARTIAL_TIMEOUT' WHEN bad > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM x""")
def extract_status_timeout(t):
    x = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("n_chars") < 100).alias("bad"), F.bool_or(c("n_chars") > 18000).alias("late"))
    return x.select("source", X.extract_state(c("n"), c("bad"), c("late")).alias("status"))


_CHECKS = ("MISSING_POINT", "MISSING_PAYLOAD", "MISSING_VECTOR", "CHUNK_ID", "KNOWLEDGE_BASE", "ITEM", "VECTOR_HASH", "EMBEDDING_ID")


@query("""WITH p AS (SELECT vec_id, label, len(embedding) AS dim FROM embeddings WHERE vec_id % 11 <> 0)
  SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'MISSING_POINT' WHEN doc_id % 13 = 0 THEN 'MISSING_PAYLOAD' WHEN dim = 0 THEN 'MISSING_VECTOR' WHEN doc_id % 17 = 1 THEN 'CHUNK_ID' WHEN label <> (n_chars % 2) AND label < 2 THEN 'KNOWLEDGE_BASE' WHEN label = 7 AND lang = 'en' THEN 'ITEM' WHEN label = 8 AND n_chars % 3 = 0 THEN 'VECTOR_HASH' WHEN label = 9 AND n_chars % 5 = 0 THEN 'EMBEDDING_ID' ELSE 'VERIFIED' END AS result FROM documents LEFT JOIN p ON vec_id = doc_id""")
def index_verification_eight(t):
    """Expected rows against stored points: eight checks in order of precedence."""
    p = t.embeddings.where("vec_id % 11 <> 0").select("vec_id", "label", F.size("embedding").alias("dim"))
    label = c("label")
    failed = (c("vec_id").isNull(), c("doc_id") % 13 == 0, c("dim") == 0, c("doc_id") % 17 == 1, (label != c("n_chars") % 2) & (label < 2), (label == 7) & (c("lang") == "en"), (label == 8) & (c("n_chars") % 3 == 0), (label == 9) & (c("n_chars") % 5 == 0))
    return t.documents.join(p, c("vec_id") == c("doc_id"), "left").select("doc_id", J.first_failure(list(zip(_CHECKS, failed, strict=True)), "VERIFIED").alias("result"))


@query("""WITH n AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k, max(value) OVER (PARTITION BY user_id) AS best, event_id FROM events)
  SELECT user_id, event_type, event_id, k::INTEGER AS rank FROM n WHERE value / 500 >= greatest(0.35::DOUBLE, 0.8::DOUBLE * best / 500) AND k <= CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 5 END""")
def packet_list_caps(t):
    """Packets of several lists merged: a floor for each group, and a cap for each list."""
    from ..operators import retrieval as R

    lists = [t.events.where(c("event_type") == k).withColumn("score", c("value") / 500) for k in ("view", "click", "purchase", "signup", "error")]
    return R.merged_packets(lists, "user_id", "event_type", "score", "event_id", {"view": 3, "click": 2}, 5).select("user_id", "event_type", "event_id", "rank")


@query("""WITH k AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 4 <> 0), n AS (SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 2 = 0) SELECT vec_id, label FROM n UNION ALL SELECT vec_id, label FROM k WHERE vec_id NOT IN (SELECT vec_id FROM n)""")
def vector_store_upsert(t):
    """New points replace those of the same id."""
    old = t.embeddings.where("vec_id % 4 <> 0").select("vec_id", "label")
    new = t.embeddings.where("vec_id % 2 = 0").select("vec_id", (c("label") + 100).alias("label"))
    return new.unionByName(old.join(new.select("vec_id"), "vec_id", "left_anti"))


@query("""WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS v, list_transform(b.embedding, lambda x: x::DOUBLE) AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 50)
  SELECT vec_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * q[i])), 6) AS dot, round(sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - q[i]) * (v[i] - q[i])))), 5) AS euclid,
   round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * q[i])) / sqrt(list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(q, lambda x: x * x))), 6) AS cosine FROM p""")
def vector_metrics(t):
    """The three metrics of a collection, of each vector with the one that begins its fifty."""
    from ..operators import retrieval as R

    q = t.embeddings.select(c("vec_id").alias("q_id"), c("embedding").alias("q"))
    rows = t.embeddings.join(q, c("q_id") == c("vec_id") - c("vec_id") % 50)
    return rows.select("vec_id", *[F.round(R.nearness(c("embedding"), c("q"), m), d).alias(m) for m, d in (("dot", 6), ("euclid", 5), ("cosine", 6))])


@query("""WITH h AS (SELECT conv_id AS run_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations), r AS (SELECT run_id, count(*) AS n_hits, sum(length(text))::BIGINT AS n_chars, max(CASE WHEN rank = 1 THEN text END) AS question FROM h GROUP BY 1)
  SELECT run_id, n_hits, n_chars, sha256(question) AS question_hash, CASE WHEN n_hits = 0 THEN 'NO_RESULTS' WHEN n_chars > 2000 THEN 'TRUNCATED' ELSE 'COMPLETED' END AS status FROM r""")
def search_run_audit(t):
    """A row for each run: hits, characters of context, hash of the question, status."""
    rows = t.conversations.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    r = rows.groupBy(c("conv_id").alias("run_id")).agg(F.count("*").alias("n_hits"), F.sum(F.length("text")).alias("n_chars"), F.max(F.when(c("rank") == 1, c("text"))).alias("question"))
    status = F.when(c("n_hits") == 0, "NO_RESULTS").when(c("n_chars") > 2000, "TRUNCATED").otherwise("COMPLETED")
    return r.select("run_id", "n_hits", "n_chars", F.sha2("question", 256).alias("question_hash"), status.alias("status"))
