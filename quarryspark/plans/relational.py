"""Join, filter, set, order and window queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import filters as S
from ..operators import joins as J
from ..operators.networks import in_networks
from ..operators import ordered as O
from .registry import NOW, now, query

c = F.col


@query("""SELECT event_id, e.user_id, a.c_name AS actor, b.c_name AS target FROM events e LEFT JOIN customer a ON a.c_custkey = e.user_id
  LEFT JOIN customer b ON b.c_custkey = CAST(json_extract_string(props, '$.k') AS BIGINT)""")
def audit_user_join(t):
    k = F.get_json_object("props", "$.k").cast("long")
    people = t.customer.select("c_custkey", "c_name")
    a, b = (people.select(c("c_custkey").alias(f"{n}_id"), c("c_name").alias(n)) for n in ("actor", "target"))
    return t.events.withColumn("k", k).join(a, c("user_id") == c("actor_id"), "left").join(b, c("k") == c("target_id"), "left").select("event_id", "user_id", "actor", "target")


@query("""SELECT event_id, l.quality FROM events e LEFT JOIN labels l ON l.doc_id = coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), user_id)""")
def audit_corpus_join(t):
    key = F.coalesce(F.get_json_object("props", "$.k").cast("long"), c("user_id"))
    return t.events.withColumn("key", key).join(t.labels, c("key") == c("doc_id"), "left").select("event_id", "quality")


@query("""SELECT n_name, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def inner_join_sum(t):
    # Lines are summed by customer before the dimension tables come in.
    by_customer = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey").agg(F.sum("l_extendedprice").alias("s"))
    rows = by_customer.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum("s"), 2).alias("total"))


@query("""SELECT n_name, coalesce(sum(n), 0)::BIGINT AS used FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey
  WHERE o_totalprice > 495000 GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1 HAVING coalesce(sum(n), 0) = 0""")
def tenants_without_usage(t):
    used = t.orders.where("o_totalprice > 495000").join(t.customer, c("o_custkey") == c("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return t.nation.join(used, c("c_nationkey") == c("n_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("used")).where("used = 0")


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def permission_semijoin(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def three_way_join(t):
    wanted = t.region.where("r_name <> 'ASIA'")
    return t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(wanted, c("n_regionkey") == c("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN c_mktsegment ELSE 'ACTIVE' END AS c_mktsegment FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey""")
def update_from_join(t):
    open_ = t.orders.where("o_orderstatus = 'O'").select("o_custkey")
    return S.updated_from(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", open_, "o_custkey", "c_mktsegment", F.lit("ACTIVE"))


@query("""SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def nested_bundle(t):
    ids = t.conversations.select("conv_id").distinct()
    both = J.bundle(ids, "conv_id", {"turns": (t.conversations, ["turn", "role"]), "users": (t.conversations.where("role = 'user'"), ["turn"])})
    return both.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.coalesce(F.size("users"), F.lit(0)).cast("long").alias("n_user"), F.array_join(F.transform("turns", lambda x: x["role"]), ",").alias("roles"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey) AS ks FROM orders GROUP BY 1), u AS (SELECT o_custkey, unnest(list_distinct(ks)) AS k FROM a) SELECT o_custkey, l_orderkey, count(*) AS n FROM u JOIN lineitem ON l_orderkey = k GROUP BY 1, 2""")
def array_containment_join(t):
    arrays = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ks"))
    return J.contained(arrays, "ks", "l_orderkey", t.lineitem).groupBy("o_custkey", "l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey OR n.n_nationkey = s.s_suppkey % 25 OR n.n_nationkey IN (1, s.s_suppkey % 7)""")
def disjunctive_join(t):
    keys = [F.array("s_nationkey"), F.array((c("s_suppkey") % 25).cast("int")), F.array(F.lit(1), (c("s_suppkey") % 7).cast("int"))]
    return J.any_of(t.supplier, keys, "n_nationkey", t.nation).select("s_suppkey", "n_nationkey")


@query("""WITH p AS (SELECT event_id, (event_id * 7919 % 40000)::BIGINT AS off FROM events), g AS (SELECT doc_id, (doc_id * 37)::BIGINT AS lo, (doc_id * 37 + n_chars % 400)::BIGINT AS hi FROM documents)
  SELECT doc_id, count(*) AS n, min(off) AS first FROM p JOIN g ON off >= lo AND off < hi GROUP BY 1""")
def offset_range_join(t):
    """Every event's offset in every document's range."""
    points = t.events.select("event_id", ((c("event_id") * 7919) % 40000).alias("off"))
    ranges = t.documents.select("doc_id", (c("doc_id") * 37).alias("lo"), (c("doc_id") * 37 + c("n_chars") % 400).alias("hi"))
    return J.in_ranges(points, "off", ranges, "lo", "hi").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("off").alias("first"))


@query("""WITH ip AS (SELECT c_custkey, '10.' || (c_custkey % 4) || '.' || (c_custkey % 256) || '.' || (c_custkey % 100) AS ip FROM customer)
  SELECT c_custkey, n FROM (SELECT c_custkey, '10.1.0.0/16' AS n FROM ip WHERE ip LIKE '10.1.%' UNION ALL SELECT c_custkey, '10.2.7.0/24' FROM ip WHERE ip LIKE '10.2.7.%' UNION ALL SELECT c_custkey, '10.0.0.0/8' FROM ip)""")
def addresses_in_networks(t):
    ip = F.format_string("10.%d.%d.%d", c("c_custkey") % 4, c("c_custkey") % 256, c("c_custkey") % 100)
    nets = t.spark.createDataFrame([("10.1.0.0/16",), ("10.2.7.0/24",), ("10.0.0.0/8",)], "n string")
    return in_networks(t.customer.select("c_custkey", ip.alias("ip")), "ip", nets, "n").select("c_custkey", "n")


@query("""WITH k AS (SELECT client_id, client_id % 16 AS a, client_id % 256 AS b FROM clients WHERE client_id IS NOT NULL),
  ip AS (SELECT client_id, a, b, CASE client_id % 3 WHEN 0 THEN '2001:DB8:' || lower(to_hex(a)) || '::' || to_hex(b) WHEN 1 THEN '::ffff:10.' || a || '.0.' || b ELSE '10.' || a || '.0.' || b END AS ip FROM k)
  SELECT client_id, ip, n FROM (SELECT *, '2001:db8:3::/48' AS n FROM ip WHERE client_id % 3 = 0 AND a = 3 UNION ALL SELECT *, '2001:db8:8::1/45' FROM ip WHERE client_id % 3 = 0 AND a BETWEEN 8 AND 15
  UNION ALL SELECT *, '::ffff:0:0/96' FROM ip WHERE client_id % 3 = 1 UNION ALL SELECT *, '10.4.0.0/255.252.0.0' FROM ip WHERE client_id % 3 = 2 AND a BETWEEN 4 AND 7 UNION ALL SELECT *, '2001:db8:0:0::11' FROM ip WHERE client_id % 3 = 0 AND a = 0 AND b = 17
  UNION ALL SELECT *, '10.1.0.0/33' FROM ip WHERE false)""")
def addresses_of_both_versions(t):
    """Addresses of versions 4 and 6 made from client ids, in networks of either."""
    k, h = c("client_id"), lambda x: F.hex(x)
    a, b = k % 16, k % 256
    ip = F.when(k % 3 == 0, F.concat(F.lit("2001:DB8:"), F.lower(h(a)), F.lit("::"), h(b))).when(k % 3 == 1, F.format_string("::ffff:10.%d.0.%d", a, b)).otherwise(F.format_string("10.%d.0.%d", a, b))
    nets = t.spark.createDataFrame([(x,) for x in ("2001:db8:3::/48", "2001:db8:8::1/45", "::ffff:0:0/96", "10.4.0.0/255.252.0.0", "2001:db8:0:0::11", "10.1.0.0/33")], "n string")
    return in_networks(t.clients.where(k.isNotNull()).select("client_id", ip.alias("ip")), "ip", nets, "n").select("client_id", "ip", "n")


@query("""SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-30 00:00:00' EXCEPT
  SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-29 00:00:00' AND ts >= TIMESTAMP '2023-12-31 00:00:00'""")
def new_key_antijoin(t):
    day = now() - F.expr("interval 1 day")
    recent = t.events.where((c("ts") >= day) & (c("ts") < now()))
    old = t.events.where((c("ts") < day) & (c("ts") >= now() - F.expr("interval 30 days")))
    return J.only_new(recent, old, ["user_id", "event_type"])


@query("""SELECT doc_id, first_id, n_copies FROM (SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS n_copies FROM documents WINDOW w AS (PARTITION BY sha256(text))) WHERE doc_id <> first_id""")
def exact_duplicates(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return rows.join(groups, "h").where("doc_id <> first_id").select("doc_id", "first_id", "n_copies")


@query("SELECT lower(p_brand) AS alias, count(DISTINCT p_type) AS n_canonical FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def ambiguous_aliases(t):
    return J.ambiguous(t.part.select(F.lower("p_brand").alias("alias"), "p_type"), "alias", "p_type")


@query("""SELECT n_name, array_to_string(list_sort(list_distinct(list(lower(s_name)) || list(lower(n_name)))), ',') AS aliases FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def alias_expansion(t):
    names = t.supplier.groupBy("s_nationkey").agg(F.collect_set(F.lower("s_name")).alias("a"))
    return t.nation.join(names, c("s_nationkey") == c("n_nationkey")).select("n_name", F.array_join(F.array_sort(F.array_union("a", F.array(F.lower("n_name")))), ",").alias("aliases"))


@query("""WITH x AS (SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
  SELECT a.l_partkey AS a, b.l_partkey AS b, min(a.o_orderkey) AS first_place, count(DISTINCT a.o_orderkey) AS n_places, 0.5::DOUBLE AS confidence FROM x a JOIN x b ON a.o_orderkey = b.o_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2""")
def cooccurrence_edges(t):
    rows = t.lineitem.select(c("l_orderkey").alias("place"), "l_partkey", F.lit(0.5).alias("confidence"))
    return J.co_occurring(rows, "place", "l_partkey", "confidence")


@query("""WITH x AS (SELECT c_custkey, c_acctbal, c_nationkey, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)
  SELECT c_custkey, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 20 THEN 'COUNT_MISMATCH' WHEN c_acctbal < 0 THEN 'BALANCE' WHEN c_nationkey = 0 THEN 'NATION' ELSE 'OK' END AS result FROM x""")
def index_verification_ladder(t):
    stored = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    checks = [("MISSING", c("n").isNull()), ("COUNT_MISMATCH", c("n") > 20), ("BALANCE", c("c_acctbal") < 0), ("NATION", c("c_nationkey") == 0)]
    return t.customer.join(stored, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", J.first_failure(checks).alias("result"))


# --- filters ------------------------------------------------------------------------------------------------


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00' AND event_type IN ('click', 'view') AND (event_type ILIKE '%LIC%' OR props ILIKE '%5%')""")
def filtered_audit(t):
    """Half-open dates (a plain end date counts whole), a split and whitelisted list, LIKE over several columns."""
    known = ("view", "click", "purchase", "signup", "error")
    wanted = [x for x in dict.fromkeys(p.strip().lower() for p in " Click,view,,bogus,click".split(",")) if x in known]
    start, end = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz") + F.expr("interval 1 day")
    like = reduce(lambda a, b: a | b, [c("event_type").ilike("%LIC%"), c("props").ilike("%5%")])
    return t.events.where((c("ts") >= start) & (c("ts") < end) & c("event_type").isin(*wanted) & like).select("event_id")


@query("""SELECT event_id, CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE user_id END AS k FROM events""")
def safe_json_cast(t):
    raw = F.nullif(F.get_json_object("props", "$.k"), F.lit(""))
    return t.events.select("event_id", F.coalesce(F.when(raw.rlike("^[0-9]+$"), raw.try_cast("bigint")), c("user_id")).alias("k"))


_QUEUE = """SELECT event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'retry' WHEN 'error' THEN 'processing' WHEN 'purchase' THEN 'processing' ELSE 'done' END AS status, ts AS next_retry_at,
  CASE WHEN event_type = 'error' THEN ts + INTERVAL 5 MINUTE END AS lease_until, CASE WHEN event_type = 'purchase' THEN ts END AS locked_at FROM events"""
_ELIGIBLE = f"""(status IN ('pending', 'retry') AND next_retry_at <= TIMESTAMP '{NOW}') OR (status = 'processing' AND (lease_until < TIMESTAMP '{NOW}' OR locked_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND))"""


def _queue(t):
    """Events as a queue of work in several states."""
    state = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "pending", "click", "retry", "error", S.RUNNING, "purchase", S.RUNNING)]), c("event_type"))
    lease, lock = F.when(c("event_type") == "error", c("ts") + F.expr("interval 5 minutes")), F.when(c("event_type") == "purchase", c("ts"))
    return t.events.select("event_id", F.coalesce(state, F.lit("done")).alias("status"), c("ts").alias("next_retry_at"), lease.alias("lease_until"), lock.alias("locked_at"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderpriority = '1-URGENT' THEN 'temporary_deleted' ELSE 'inactive' END AS lifecycle,
  CASE WHEN o_orderpriority = '2-HIGH' OR o_orderstatus = 'P' THEN 'high' ELSE 'medium' END AS severity FROM orders""")
def lifecycle_and_severity(t):
    cancelled = F.when(c("o_orderpriority") == "1-URGENT", "Deactivation_Requested")
    action, outcome = F.when(c("o_orderpriority") == "2-HIGH", "refresh_failed").otherwise("login"), F.when(c("o_orderstatus") == "P", S.RATE_LIMITED).otherwise("success")
    return t.orders.select("o_orderkey", S.lifecycle(c("o_orderstatus") == "O", cancelled).alias("lifecycle"), S.severity(action, outcome).alias("severity"))


@query(f"SELECT event_id, status FROM ({_QUEUE}) WHERE {_ELIGIBLE}")
def outbox_eligible(t):
    due = S.eligible(c("status"), c("next_retry_at"), c("lease_until"), c("locked_at"), now(), 300)
    return _queue(t).where(due).select("event_id", "status")


@query(f"""SELECT event_id, 'processing' AS status, TIMESTAMP '{NOW}' AS locked_at, TIMESTAMP '{NOW}' + INTERVAL 300 SECOND AS lease_until, 'worker-1' AS lock_owner FROM ({_QUEUE}) WHERE {_ELIGIBLE} ORDER BY event_id LIMIT 100""")
def outbox_claim(t):
    """The next micro-batch of the queue: at most 100 by id, leased to a worker."""
    return S.claim(_queue(t), "event_id", now(), 100, " worker-1 ").select("event_id", "status", "locked_at", "lease_until", "lock_owner")


@query("""SELECT o_orderkey, o_orderstatus = 'F' AND (o_orderpriority = '5-LOW' OR o_orderdate > TIMESTAMP '1996-06-01') AS active, o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' AS counted FROM orders""")
def active_bans(t):
    """Bans without an expiry or with one to come, if not released; and ingestion that counts by its status."""
    released, expires = F.when(c("o_orderstatus") != "F", c("o_orderdate")), F.when(c("o_orderpriority") != "5-LOW", c("o_orderdate"))
    status = F.when(c("o_orderpriority") == "1-URGENT", "rejected").when(c("o_orderpriority") == "2-HIGH", "failed").otherwise("completed")
    at = F.lit("1996-06-01").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", S.ban_active(released, expires, at).alias("active"), S.counted(status).alias("counted"))


# --- windows and order ----------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_tenant(t):
    return O.latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'error')) WHERE n = 1""")
def latest_terminal_per_step(t):
    return O.latest(t.events.where(c("event_type").isin("purchase", "error")), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id < 5000))
  SELECT event_id, ts, position::INTEGER AS position, (SELECT count(*) FROM r) > 50 AS has_next FROM r WHERE position <= 50""")
def keyset_page(t):
    return O.keyset_page(t.events.select("event_id", "ts"), "ts", "event_id", ("2024-01-15 00:00:00", 5000), 50)


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) AS n_trailing FROM events WHERE event_type = 'error'""")
def trailing_failures(t):
    return O.trailing_count(t.events.where("event_type = 'error'"), ["user_id"], "ts", 300).select("event_id", "n_trailing")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n_minute,
  count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n_day FROM events""")
def trailing_and_daily(t):
    rows = O.trailing_count(t.events, ["user_id"], "ts", 60, "n_minute").withColumn("day", F.to_date("ts"))
    from pyspark.sql import Window as W

    return rows.select("event_id", "n_minute", F.count("*").over(W.partitionBy("user_id", "day")).alias("n_day"))


@query("""WITH r AS (SELECT event_id, floor(epoch(ts) / 3600)::BIGINT AS slot, user_id, ts FROM events), n AS (SELECT event_id, slot, row_number() OVER (PARTITION BY user_id, slot ORDER BY ts, event_id) AS n FROM r)
  SELECT event_id, slot, n::INTEGER AS n, n <= 2 AS allowed FROM n""")
def fixed_window_limit(t):
    return O.fixed_window_limit(t.events, ["user_id"], "ts", "event_id", 3600, 2).select("event_id", "slot", "n", "allowed")


@query("""SELECT event_id, n::INTEGER AS n, n <= 10 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase')""")
def quota_reservation(t):
    rows = t.events.where("event_type = 'purchase'").withColumn("period", F.date_format("ts", "yyyy-MM"))
    return O.reserve(rows, ["user_id", "period"], ["ts", "event_id"], 10).select("event_id", "n", "allowed")


@query("""WITH r AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempts FROM events WHERE event_type = 'error')
  SELECT event_id, attempts::INTEGER AS attempts, CASE WHEN attempts >= 5 THEN 'dead_letter' ELSE 'retry' END AS status, CASE WHEN attempts < 5 THEN floor(epoch(ts))::BIGINT + 60 * attempts END AS due FROM r""")
def retry_schedule(t):
    rows = O.reserve(t.events.where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], 5).withColumnRenamed("n", "attempts")
    status, due = O.retry_state(c("attempts"), c("ts"), 60, 5)
    return rows.select("event_id", "attempts", status.alias("status"), due.alias("due"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 20 AS over FROM events GROUP BY 1, 2""")
def daily_counter(t):
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), (F.count("*") > 20).alias("over"))


@query("""SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_minutes(t):
    return t.events.groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey OFFSET 100 LIMIT 50")
def offset_page(t):
    return t.orders.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_topn(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS FIRST, doc_id LIMIT 100")
def nulls_first_scan(t):
    return t.documents.join(t.labels, "doc_id", "left").orderBy(F.asc_nulls_first("quality"), "doc_id").limit(100).select("doc_id", "quality")


# --- set operations -------------------------------------------------------------------------------------------


@query("SELECT trim(c_name) AS name FROM customer WHERE trim(c_name) <> '' UNION SELECT trim(s_name) FROM supplier WHERE trim(s_name) <> ''")
def union_distinct_names(t):
    names = lambda df, n: df.select(F.trim(n).alias("name"))
    return names(t.customer, "c_name").union(names(t.supplier, "s_name")).where("name <> ''").distinct()


@query("""SELECT event_id, kind FROM (SELECT event_id, 'error' AS kind FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'high' FROM events WHERE value > 400 UNION ALL SELECT event_id, 'early' FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00')""")
def union_all_signals(t):
    """One pass: each row is exploded into its signals, in place of one scan for each of them."""
    signals = {"error": c("event_type") == "error", "high": c("value") > 400, "early": c("ts") < F.lit("2024-01-02").cast("timestamp_ntz")}
    return t.events.select("event_id", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in signals.items()]))).alias("kind"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def expected_minus_applied(t):
    return t.customer.select("c_custkey").join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti")


@query("""SELECT name FROM (SELECT o_orderpriority AS name, row_number() OVER (PARTITION BY lower(o_orderpriority) ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def ordered_distinct(t):
    return O.latest(t.orders.withColumn("k", F.lower("o_orderpriority")), ["k"], [c("o_orderkey")]).select(c("o_orderpriority").alias("name"))


@query("""SELECT user_id, event_type AS key, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_latest_wins(t):
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    rows = t.events.select("user_id", c("event_type").alias("key"), "ts", "event_id", F.struct("ts", "event_id").alias("version"))
    return O.upsert(rows.where(c("ts") < half), rows.where(c("ts") >= half), ["user_id", "key"], "version").select("user_id", "key", "ts")


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) FROM events)""")
def idempotent_append(t):
    """Repeated keys are appended once; rows without a key are always kept."""
    keyed = t.events.withColumn("day", F.to_date("ts"))
    return keyed.where(c("day").isNotNull()).dropDuplicates(["user_id", "event_type", "day"]).unionByName(keyed.where(c("day").isNull())).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, json_object('id', o_orderkey, 'status', o_orderstatus)::VARCHAR AS line FROM orders ORDER BY o_orderkey LIMIT 50000""")
def json_export(t):
    return t.orders.orderBy("o_orderkey").limit(50000).select("o_orderkey", F.to_json(F.struct(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"))).alias("line"))
