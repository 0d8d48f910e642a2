"""Control of queues, alerts and limits: what the services decide row by row, as operators on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import small_side
from .aggregates import first_of_group

#: Stages of the processing chain in order.
STAGES = ("understanding", "discovery", "embedding", "indexing")
#: Seconds by event type: time limit of a handler, lease, heartbeat; and of all other types (fixed values).
POLICIES = {
    "security.audit_event": (15, 60, 10),
    "email.notification": (30, 120, 15),
    "email_2fa": (30, 120, 15),
    "email_invite": (30, 120, 15),
    "knowledge.ingest_pipeline": (1800, 2100, 30),
    "knowledge.index_build": (3600, 3900, 60),
    "knowledge.ingest_item_reprocess": (1800, 2100, 30),
    "knowledge.recovery_sweep": (600, 720, 30),
    "kb.discovery_requested": (1800, 2100, 30),
    "kb.embedding_requested": (1800, 2100, 30),
    "kb.indexing_requested": (3600, 3900, 60),
    "url.fetch": (120, 180, 15),
    "file.parse": (600, 720, 30),
}
DEFAULT_POLICY = (15, 300, 30)
#: Limits of a chat by scope: question, history items and characters, retrieval items and characters, sources, calls a
#: day and a minute (fixed values).
CHAT_LIMITS = {
    "demo": (1024, 8, 2400, 6, 1800, 3, 100, 10),
    "starter": (2400, 30, 12000, 20, 6000, 5, 5000, 120),
    "default": (2400, 30, 12000, 20, 6000, 8, 5000, 120),
}
LIMIT_NAMES = ("max_question_chars", "max_history_items", "max_history_chars", "max_retrieval_items", "max_retrieval_chars", "max_sources", "daily_cap", "minute_cap")


def alert_key(category: Column, severity: Column, signal: Column) -> Column:
    return F.concat_ws(":", category, F.lower(F.trim(severity)), F.trim(signal))


def upsert_alerts(old: DataFrame, signals: DataFrame, at: str, order: str) -> DataFrame:
    """(alert_key, value, hit_count, status, first_seen_at, last_seen_at, acknowledged_at): ``signals`` (alert_key,
    value, at) fold into ``old`` alerts. Each signal is a hit; the newest gives the value, and opens the alert anew."""
    new = signals.groupBy("alert_key").agg(F.max_by("value", F.struct(at, order)).alias("v"), F.count("*").alias("hits"), F.min(at).alias("a"), F.max(at).alias("z"))
    rows = old.join(new, "alert_key", "full_outer")
    hit = F.col("hits").isNotNull()
    return rows.select(
        "alert_key",
        F.when(hit, F.col("v")).otherwise(F.col("value")).alias("value"),
        (F.coalesce("hit_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).alias("hit_count"),
        F.when(hit, F.lit("open")).otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen_at", "a").alias("first_seen_at"),
        F.coalesce("z", "last_seen_at").alias("last_seen_at"),
        F.when(hit, None).otherwise(F.col("acknowledged_at")).alias("acknowledged_at"),
    )


def within_backlog(arrivals: DataFrame, waiting: DataFrame, by: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Arrivals with ``accepted``: those that still found the backlog of their queue below the limit. Rejected ones don't
    count, so the first ones up to what is free are the accepted. ``waiting`` has a row for each queue with its number in ``waiting``;
    the last column of ``order`` is unique. Only the first ``limit`` of a queue are sorted; the last accepted one of each is its edge,
    which all arrivals are compared with. A null queue is a queue of its own."""
    names = {c: f"__{c}" for c in by}
    first = first_of_group(arrivals.select(*by, *order), by, [F.col(c) for c in order], order[-1], limit)
    first = first.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    free = F.greatest(F.lit(0), F.lit(limit) - F.coalesce("waiting", F.lit(0)))
    side = waiting.select(*[F.col(c).alias(n) for c, n in names.items()], "waiting")
    within = first.join(side, _agree(names), "left").where(F.col("__n") <= free)
    edges = within.groupBy(*by).agg(F.max(F.struct(*order)).alias("__edge")).withColumnsRenamed(names)
    found = arrivals.join(small_side(edges), _agree(names), "left")
    return found.withColumn("accepted", F.coalesce(F.struct(*order) <= F.col("__edge"), F.lit(False))).drop("__edge", *names.values())


def _agree(names: dict[str, str]) -> Column:
    match = F.lit(True)
    for a, b in names.items():
        match = match & F.col(a).eqNullSafe(F.col(b))
    return match


def event_policy(kind: Column, default_timeout: int) -> Column:
    """Struct of time limit, lease and heartbeat seconds of an event type; a lease outlasts its handler."""
    table = F.create_map(*[F.lit(x) for k, (limit, lease, beat) in POLICIES.items() for x in (k, f"{max(1, limit)},{max(lease, limit + 30)},{max(5, beat)}")])
    own = F.split(F.element_at(table, F.trim(kind)), ",")
    limit = max(1, default_timeout)
    other = (limit, max(DEFAULT_POLICY[1], limit + 60), DEFAULT_POLICY[2])
    names = ("timeout_s", "lease_s", "heartbeat_s")
    return F.struct(*[F.coalesce(F.get(own, F.lit(k)).cast("int"), F.lit(x)).alias(n) for k, (n, x) in enumerate(zip(names, other, strict=True))])


def recovered(jobs: DataFrame, status: str, kind: Column, locked_at: str, beat_at: str, now: Column, default_timeout: int = 15) -> DataFrame:
    """Jobs with ``action``: keep what is done or waiting; of those running, recover what has outlived its lease without
    a heartbeat since, end what runs longer than its handler may, and beat for the rest."""
    seconds = lambda x: F.unix_micros(x.cast("timestamp")) / 1_000_000
    policy = event_policy(kind, default_timeout)
    since, quiet = seconds(now) - seconds(F.col(locked_at)), seconds(now) - seconds(F.greatest(locked_at, beat_at))
    action = F.when(F.col(status) != "running", "keep").when(quiet > policy["lease_s"], "recover").when(since > policy["timeout_s"], "time_out").otherwise("heartbeat")
    return jobs.withColumn("action", action)


def next_stage(events: DataFrame, key: str, stage: str, status: str, order: Sequence[str], stages: Sequence[str] = STAGES) -> DataFrame:
    """(key, n_done, next_stage, state): by the newest event of each stage, the first stage that isn't completed;
    failed if its newest event says so, done if none is left."""
    newest = events.groupBy(key, stage).agg(F.max_by(status, F.struct(*order)).alias("s"))
    rows = newest.groupBy(key).agg(*[F.max(F.when(F.col(stage) == s, F.col("s"))).alias(f"__{k}") for k, s in enumerate(stages)])
    todo = F.coalesce(*[F.when(F.coalesce(F.col(f"__{k}"), F.lit("")) != "completed", F.lit(k)) for k in range(len(stages))], F.lit(len(stages)))
    names = F.array(*[F.lit(s) for s in stages])
    now = F.get(F.array(*[F.col(f"__{k}") for k in range(len(stages))]), todo)
    state = F.when(todo == len(stages), "done").when(now == "failed", "failed").when(now.isNull(), "due").otherwise("running")
    return rows.select(key, todo.alias("n_done"), F.get(names, todo).alias("next_stage"), state.alias("state"))


def chat_limits(package: Column, demo: Column) -> Column:
    """Struct of scope and limits of a tenant's plan."""
    scope = F.when(demo, "demo").when(F.lower(F.trim(package)) == "starter", "starter").otherwise("default")
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for s, v in CHAT_LIMITS.items() for x in (s, v[k])]), scope)
    return F.struct(scope.alias("scope"), *[pick(k).alias(n) for k, n in enumerate(LIMIT_NAMES)])


def confidence(base: Column, hits: Column, ambiguous: Column) -> Column:
    """A base between 0 and 1, more for each further hit, halved if ambiguous."""
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base))
    value = F.when(hits > 1, F.least(F.lit(1.0), value + 0.05 * (hits - 1))).otherwise(value)
    return F.bround(F.when(ambiguous, value * 0.5).otherwise(value), 4)


def confident(candidates: DataFrame, kind: str, score: str, floors: dict[str, float]) -> DataFrame:
    """Candidates at or above the floor of their kind; kinds without one pass."""
    floor = F.element_at(F.create_map(*[F.lit(x) for k, v in floors.items() for x in (k, float(v))]), F.col(kind))
    return candidates.where(F.coalesce(F.col(score) >= floor, floor.isNull()))


def index_changes(stored: DataFrame, wanted: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): what a rebuild has to do: delete stored rows that aren't wanted, insert new ones, replace those of
    another version, keep the rest."""
    both = stored.select(key, F.col(version).alias("__old"), F.lit(1).alias("__s")).join(wanted.select(key, F.col(version).alias("__new"), F.lit(1).alias("__w")), key, "full_outer")
    change = F.when(F.col("__w").isNull(), "delete").when(F.col("__s").isNull(), "insert").when(~F.col("__old").eqNullSafe(F.col("__new")), "replace").otherwise("keep")
    return both.select(key, change.alias("change"))
