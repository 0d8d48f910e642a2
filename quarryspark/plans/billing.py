"""Billing, quota and subscription queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import billing as B
from ..operators import ordered as O
from .registry import query

c = F.col
_CENTS = "round_even(l_extendedprice * 100, 0)::BIGINT"


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT day, date_trunc('month', day)::DATE + 4 AS fifth FROM d),
  p AS (SELECT day, (fifth + CASE isodow(fifth) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)::DATE AS due_day FROM f)
  SELECT day, due_day, strftime(CASE WHEN day < due_day THEN day - INTERVAL 1 MONTH ELSE day END, '%Y-%m') AS period_key FROM p""")
def billing_period_key(t):
    return t.orders.select(F.to_date("o_orderdate").alias("day")).distinct().select("day", B.due_day(c("day")).alias("due_day"), B.period_key(c("day")).alias("period_key"))


@query("""SELECT o_orderkey, (floor(round_even(o_totalprice * 100, 0)::BIGINT * m * (100 - d) / 100.0 / 100)::BIGINT * 100)::BIGINT AS price FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 12 END AS m, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 15 END AS d FROM orders)""")
def period_prices(t):
    period = F.element_at(F.array(*[F.lit(x) for x in ("monthly", "quarterly", "yearly")]), (c("o_orderkey") % 3 + 1).cast("int"))
    return t.orders.select("o_orderkey", B.period_price(F.bround(c("o_totalprice") * 100, 0).cast("long"), period).alias("price"))


@query("SELECT doc_id, CASE WHEN n_chars * 700000 > 0 THEN greatest(1, ceil(n_chars * 700000 / 1073741824.0))::BIGINT ELSE 0 END AS gb FROM documents")
def storage_gb(t):
    return t.documents.select("doc_id", B.storage_gb(c("n_chars") * 700000).alias("gb"))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s FROM orders), y AS (SELECT o_orderkey, s, (s + INTERVAL 1 MONTH)::DATE AS e, s + (o_orderkey % 40)::INTEGER AS d FROM x)
  SELECT o_orderkey, round(least(1.0, greatest(0.0, (date_diff('day', d, e) + 1)::DOUBLE / greatest(date_diff('day', s, e) + 1, 1))), 9) AS share FROM y""")
def proration(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("s"))
    share = B.proration(c("s"), F.add_months("s", 1), F.date_add(c("s"), (c("o_orderkey") % 40).cast("int")))
    return rows.select("o_orderkey", F.round(share, 9).alias("share"))


@query("""SELECT sum(CASE WHEN o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' THEN round_even(o_totalprice * 100, 0)::BIGINT ELSE 0 END)::BIGINT AS paid_cents,
  sum(greatest(0, round_even(round_even(o_totalprice * 100, 0)::BIGINT * (100 - d) / 100.0::DOUBLE, 0)::BIGINT + 500 * (o_orderkey % 4) + 500 * (o_orderkey % 2)))::BIGINT AS mrr_cents,
  12 * sum(greatest(0, round_even(round_even(o_totalprice * 100, 0)::BIGINT * (100 - d) / 100.0::DOUBLE, 0)::BIGINT + 500 * (o_orderkey % 4) + 500 * (o_orderkey % 2)))::BIGINT AS arr_cents
  FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 15 END AS d FROM orders)""")
def revenue_mrr(t):
    k = c("o_orderkey")
    cents = F.bround(c("o_totalprice") * 100, 0).cast("long")
    mrr = F.sum(B.expected_mrr(cents, F.when(k % 3 == 0, 0).when(k % 3 == 1, 7).otherwise(15), k % 4, k % 2))
    paid = (c("o_orderstatus") == "F") & (c("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return t.orders.agg(F.sum(F.when(paid, cents).otherwise(0)).alias("paid_cents"), mrr.alias("mrr_cents"), (12 * mrr).alias("arr_cents"))


@query(f"""SELECT c_mktsegment AS plan, l_returnflag AS code, sum(greatest(0, {_CENTS} // greatest(1, l_quantity::BIGINT)) * greatest(1, l_quantity::BIGINT))::BIGINT AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def invoice_line_explode(t):
    """Lines nested in their invoice as JSON, read back and summed."""
    unit = F.expr("bigint(bround(l_extendedprice * 100, 0)) div greatest(1, bigint(l_quantity))")
    line = F.struct(c("l_returnflag").alias("code"), unit.alias("unit"), c("l_quantity").cast("long").alias("qty"))
    invoices = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(line)).alias("lines"))
    rows = invoices.select("l_orderkey", F.explode(F.from_json("lines", "array<struct<code:string,unit:bigint,qty:bigint>>")).alias("x")).where(c("x.code").isin("A", "R"))
    joined = rows.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey"))
    return joined.groupBy(c("c_mktsegment").alias("plan"), "x.code").agg(F.sum(F.greatest(F.lit(0), c("x.unit")) * F.greatest(F.lit(1), c("x.qty"))).alias("cents")).select("plan", "code", "cents")


@query("""WITH u AS (SELECT user_id, count(*) AS used FROM events GROUP BY 1) SELECT user_id, used, greatest(0, 60 - used) AS remaining_included, greatest(0, 20 - greatest(0, used - 60)) AS remaining_addon,
  greatest(0, 80 - used) AS remaining_total, least(100, greatest(0, round_even(100.0::DOUBLE * used / 80, 0)))::INTEGER AS percent FROM u""")
def quota_summary(t):
    u = t.events.groupBy("user_id").agg(F.count("*").alias("used"))
    return u.select("user_id", "used", B.question_quota(c("used"), F.lit(60), F.lit(20)).alias("q")).select("user_id", "used", "q.*")


@query("""WITH r AS (SELECT source, sum(n_chars)::BIGINT AS live FROM documents GROUP BY 1) SELECT source, greatest(live, 70000) AS used FROM r""")
def training_quota(t):
    return t.documents.groupBy("source").agg(F.greatest(F.sum("n_chars"), F.lit(70000).cast("long")).alias("used"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
  SELECT c_custkey, CASE WHEN coalesce(o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01', false) THEN 'restricted' WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'restricted' WHEN c_mktsegment = 'BUILDING' THEN 'trial' ELSE 'active' END AS state
  FROM customer LEFT JOIN (SELECT * FROM l WHERE n = 1) x ON o_custkey = c_custkey""")
def subscription_state(t):
    last = O.latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    rows = t.customer.join(last, c("o_custkey") == c("c_custkey"), "left")
    overdue = F.coalesce((c("o_orderstatus") == "O") & (c("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), F.lit(False))
    return rows.select("c_custkey", B.subscription_state(overdue, c("c_mktsegment") == "BUILDING", c("c_acctbal") < 0).alias("state"))


@query("""WITH f AS (SELECT o_custkey, max(o_orderdate) AS failed FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), p AS (SELECT o_custkey, max(o_orderdate) AS paid FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT o_custkey, CAST(failed AS DATE) + 7 AS grace_until, coalesce(paid > failed, false) AS settled FROM f LEFT JOIN p USING (o_custkey)""")
def payment_grace(t):
    when = lambda s: F.max(F.when(c("o_orderstatus") == s, c("o_orderdate")))
    rows = t.orders.groupBy("o_custkey").agg(when("O").alias("failed"), when("F").alias("paid")).where(c("failed").isNotNull())  # both in one pass
    return rows.select("o_custkey", F.date_add(F.to_date("failed"), 7).alias("grace_until"), F.coalesce(c("paid") > c("failed"), F.lit(False)).alias("settled"))


@query("""SELECT o_orderkey, CASE WHEN d >= 14 THEN 'deleted' WHEN d >= 7 THEN 'deactivated' WHEN d >= 0 THEN 'final_notice' WHEN d = -1 THEN 'second_notice' WHEN d = -2 THEN 'first_notice' ELSE 'scheduled' END AS status
  FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-15') AS d FROM orders)""")
def cancellation_timetable(t):
    return t.orders.select("o_orderkey", B.cancellation_status(F.to_date("o_orderdate"), F.lit("1996-06-15").cast("date")).alias("status"))


@query("""SELECT user_id, n, CASE WHEN n >= 100 THEN 100 WHEN n >= 90 THEN 90 WHEN n >= 80 AND user_id % 2 = 1 THEN 80 END AS level FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def usage_warning_levels(t):
    u = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return u.select("user_id", "n", B.warning_level(c("n"), F.when(c("user_id") % 2 == 0, 80).otherwise(0)).alias("level"))


@query("""SELECT c_custkey, c_name, p_retailprice FROM customer LEFT JOIN part ON p_partkey = c_custkey AND p_size > 25""")
def catalog_left_join(t):
    active = t.part.where("p_size > 25").select("p_partkey", "p_retailprice")
    return t.customer.join(active, c("p_partkey") == c("c_custkey"), "left").select("c_custkey", "c_name", "p_retailprice")


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, (round_even(o_totalprice * 100, 0)::BIGINT + 500 * (o_orderkey % 3))::BIGINT AS next_invoice_cents FROM orders""")
def next_invoice_estimate(t):
    return t.orders.select("o_orderkey", F.date_format(F.add_months("o_orderdate", 1), "yyyy-MM-dd").alias("next_month"), (F.bround(c("o_totalprice") * 100, 0).cast("long") + 500 * (c("o_orderkey") % 3)).alias("next_invoice_cents"))


@query("SELECT conv_id, turn, round(length(text) // 4 / 1000.0::DOUBLE * 0.15::DOUBLE + length(text) / 1000.0::DOUBLE * 0.6::DOUBLE, 9) AS cost FROM conversations")
def llm_cost(t):
    return t.conversations.select("conv_id", "turn", F.round(B.llm_cost(F.floor(F.length("text") / 4), F.length("text"), 0.15, 0.6), 9).alias("cost"))


@query("""SELECT user_id, n, n <= 70 AS within_questions, distinct_days <= 25 AS within_days FROM (SELECT user_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS distinct_days FROM events GROUP BY 1)""")
def limit_checks(t):
    u = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("d"))
    return u.select("user_id", "n", B.within(c("n"), F.lit(70)).alias("within_questions"), B.within(c("d"), F.lit(25)).alias("within_days"))
