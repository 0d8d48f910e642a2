"""Conditions on rows that several services share: states, due work, bans, optional filters, updates from a join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of work that waits, of work under way, and of ingestion that isn't counted; the cancellation
#: that makes an inactive tenant temporarily deleted; actions and the outcome of high severity.
WAITING, RUNNING, NOT_COUNTED = ("pending", "retry"), "processing", ("rejected", "failed")
DEACTIVATION = "deactivation_requested"
FAILED_ACTIONS, RATE_LIMITED = ("login_failed", "platform_admin_login_failed", "refresh_failed", "platform_admin_refresh_failed"), "rate_limited"


def given(rows: DataFrame, wanted: Mapping[str, object], ignored: Sequence[str] = ()) -> DataFrame:
    """Rows whose columns have the wanted values; names without a value, and ignored ones, are skipped."""
    conditions = [F.col(name) == value for name, value in wanted.items() if value is not None and name not in ignored]
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def counted(status: Column) -> Column:
    """Whether ingestion of that status counts; a null status doesn't, as under SQL's NOT IN."""
    return ~status.isin(*NOT_COUNTED)


def lifecycle(is_active: Column, cancellation: Column) -> Column:
    """active, inactive, or temporary_deleted of a tenant; a null flag is not active."""
    leaving = F.coalesce(F.lower(cancellation) == DEACTIVATION, F.lit(False))
    return F.when(is_active, "active").when(leaving, "temporary_deleted").otherwise("inactive")


def severity(action: Column, outcome: Column) -> Column:
    return F.when(action.isin(*FAILED_ACTIONS) | (outcome == RATE_LIMITED), "high").otherwise("medium")


def ban_active(released_at: Column, expires_at: Column, now: Column) -> Column:
    """Neither released nor expired; without an expiry a ban stays."""
    return released_at.isNull() & (expires_at.isNull() | (expires_at > now))


def eligible(status: Column, due_at: Column, lease_until: Column, locked_at: Column, now: Column, stale_seconds: int) -> Column:
    """Work to hand out: waiting and due, or under way with an expired lease or a stale lock. Null times never are."""
    stale = now - F.make_dt_interval(secs=F.lit(max(1, stale_seconds)))
    lost = F.coalesce(lease_until < now, F.lit(False)) | F.coalesce(locked_at < stale, F.lit(False))
    return F.coalesce((status.isin(*WAITING) & (due_at <= now)) | ((status == RUNNING) & lost), F.lit(False))


def claim(queue: DataFrame, order: str, now: Column, limit: int, owner: str | None, stale_seconds: int = 300, lease_seconds: int = 300) -> DataFrame:
    """The next ``limit`` eligible rows by ``order``, with status, locked_at, lease_until and lock_owner as after the
    claim. A queue's limit bounds the result, so only it is sorted in one task."""
    columns = (F.col(x) for x in ("status", "next_retry_at", "lease_until", "locked_at"))
    taken = queue.where(eligible(*columns, now, stale_seconds)).orderBy(order).limit(limit)
    lease = now + F.make_dt_interval(secs=F.lit(max(1, lease_seconds)))
    return taken.withColumns({"status": F.lit(RUNNING), "locked_at": now, "lease_until": lease, "lock_owner": F.lit((owner or "").strip() or None)})


def updated_from(rows: DataFrame, key: str, changes: DataFrame, change_key: str, column: str, value: Column) -> DataFrame:
    """``rows`` with ``column`` set to ``value`` (over both sides) where ``changes`` has the key; a key that it holds
    several times is taken once, with the least of each of its columns."""
    others = [c for c in changes.columns if c != change_key]
    one = changes.groupBy(F.col(change_key).alias("__key")).agg(F.lit(True).alias("__hit"), *[F.min(c).alias(c) for c in others])
    joined = rows.join(one, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).select(*rows.columns)
