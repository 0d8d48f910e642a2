"""Issues from their occurrences and status changes, kept in a stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses that an occurrence ends; characters of a message that are kept (fixed values).
TERMINAL, MESSAGE_CHARS = ("RESOLVED", "IGNORED"), 4000
_LATEST = ("severity", "message", "job_id", "step")


def upsert_issues(stored: DataFrame | None, events: DataFrame, key: Sequence[str]) -> DataFrame:
    """``stored`` issues after a batch of ``events``, as if these had come one by one in the order of (ts, order).

    An event without a ``status`` is an occurrence: the first one opens the issue; each counts, sets last_seen_at and the
    severity, the message, job and step where it has some, merges the top-level keys of its ``metadata`` (JSON text; values of any
    nesting are VARIANTs on the way), and opens an issue of a terminal status again. An event with a status sets it, and
    resolved_at if it is terminal; of an issue that there isn't yet it does nothing. Null keys are equal; metadata that isn't a
    JSON object is as none; an issue's metadata has its keys in order. One pass of partial aggregates for the batch, and one for its
    metadata; no issue's events are gathered."""
    at, occurs = F.struct("ts", "order"), F.col("status").isNull()
    some = lambda name: occurs & (F.coalesce(F.col(name), F.lit("")) != "")
    batch = events.groupBy(*key).agg(
        F.min(F.when(occurs, at)).alias("__first"),
        F.max(F.when(occurs, at)).alias("__last"),
        F.count_if(occurs).alias("__n"),
        F.max(F.when(~occurs, F.struct("ts", "order", "status"))).alias("__set"),
        F.max_by("severity", F.when(occurs, at)).alias("__severity"),
        F.max_by(F.substring("message", 1, MESSAGE_CHARS), F.when(some("message"), at)).alias("__message"),
        F.max_by("job_id", F.when(some("job_id"), at)).alias("__job_id"),
        F.max_by("step", F.when(some("step"), at)).alias("__step"),
    )
    new = _merged(events.where(occurs), key)
    batch = _joined(batch, new.withColumnRenamed("metadata", "__metadata"), key, "left")
    if stored is None:
        kinds = dict(events.dtypes)
        shape = [f"`{k}` {kinds[k]}" for k in key] + [f"first_seen_at {kinds['ts']}", f"last_seen_at {kinds['ts']}", "occurrence_count long", "status string", f"resolved_at {kinds['ts']}", *[f"{c} {kinds[c]}" for c in _LATEST], "metadata string"]
        stored = events.sparkSession.createDataFrame([], ", ".join(shape))
    old = stored.withColumn("__old", F.lit(True))
    both = _joined(old, batch, key, "full")
    first, last, change = F.col("__first"), F.col("__last"), F.col("__set")
    known = F.col("__old").isNotNull()
    # A change counts if the issue was there: stored, or opened in the batch before it.
    set_at = F.struct(change["ts"].alias("ts"), change["order"].alias("order"))
    counts = change.isNotNull() & (known | F.coalesce(set_at > first, F.lit(False)))
    counts = F.coalesce(counts, F.lit(False))
    base = F.when(counts, change["status"]).otherwise(F.coalesce("status", F.lit("OPEN")))
    since = F.when(counts, F.coalesce(last > set_at, F.lit(False))).otherwise(last.isNotNull())
    again = since & base.isin(*TERMINAL)
    resolved = F.when(again, None).when(counts, F.when(base.isin(*TERMINAL), change["ts"])).otherwise(F.col("resolved_at"))
    merged = F.when(F.col("__metadata").isNull(), F.col("metadata")).when(F.col("metadata").isNull(), F.col("__metadata")).otherwise(_over(F.col("metadata"), F.col("__metadata")))
    return both.where(known | (F.col("__n") > 0)).select(
        *key,
        F.coalesce("first_seen_at", first["ts"]).alias("first_seen_at"),
        F.coalesce(last["ts"], F.col("last_seen_at")).alias("last_seen_at"),
        (F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("occurrence_count"),
        F.when(again, "OPEN").otherwise(base).alias("status"),
        resolved.alias("resolved_at"),
        *[F.coalesce(f"__{c}", c).alias(c) for c in _LATEST],
        merged.alias("metadata"),
    )


def _joined(a: DataFrame, b: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """A join on keys of which nulls are equal; each key stands once in the result."""
    right = b.withColumnsRenamed({k: f"__{k}_" for k in key})
    match = F.lit(True)
    for k in key:
        match = match & a[k].eqNullSafe(right[f"__{k}_"])
    both = a.join(right, match, how)
    return both.withColumns({k: F.coalesce(k, f"__{k}_") for k in key}).drop(*[f"__{k}_" for k in key]) if how == "full" else both.drop(*[f"__{k}_" for k in key])


def _entries(text):
    """(k, v) of a JSON object's top level, v as JSON text again."""
    return F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))


def _object(entries):
    """A JSON object of (k, v), by k."""
    return F.to_json(F.map_from_entries(F.transform(F.array_sort(entries), lambda e: F.struct(e["k"], F.parse_json(e["v"])))))


def _merged(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, metadata): for each top-level key of the rows' metadata the latest value."""
    each = rows.select(*key, F.struct("ts", "order").alias("__at"), F.explode(_entries(F.col("metadata"))).alias("__e"))
    latest = each.groupBy(*key, F.col("__e.k").alias("k")).agg(F.max_by("__e.v", "__at").alias("v"))
    return latest.groupBy(*key).agg(_object(F.collect_list(F.struct("k", "v"))).alias("metadata"))


def _over(old, new):
    """One JSON object over another."""
    added = _entries(new)
    names = F.transform(added, lambda e: e["k"])
    return _object(F.concat(F.filter(_entries(old), lambda e: ~F.array_contains(names, e["k"])), added))
