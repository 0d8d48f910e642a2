"""Jobs as streams: which stages and leases ended in time, and which never did. Interval joins of two streams with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.control import STAGES


def _left(rows: DataFrame, late: str, at: str) -> DataFrame:
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def next_stage(stage: Column) -> Column:
    """The stage after one; null after the last one or an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in zip(STAGES, STAGES[1:], strict=False) for x in pair]), stage)


def stage_ends(started: DataFrame, ended: DataFrame, within: str, late: str = "10 minutes") -> DataFrame:
    """(job_id, stage, started_at, ended_at, state, next_stage) from two streams: ``started`` (job_id, stage, started_at) and ``ended`` (job_id, stage,
    ended_at, status). A stage that ends within the time is completed, and its next one is due, or failed; one that doesn't is timed out, which is told once
    both watermarks have passed its time. State is held for that time only; rows beyond ``late`` are dropped."""
    a = _left(started.select("job_id", "stage", "started_at"), late, "started_at")
    b = _left(ended.select(F.col("job_id").alias("__job"), F.col("stage").alias("__stage"), "ended_at", "status"), late, "ended_at")
    inside = (F.col("job_id") == F.col("__job")) & (F.col("stage") == F.col("__stage")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    state = F.when(F.col("ended_at").isNull(), "timed_out").when(F.col("status") == "failed", "failed").otherwise("completed")
    out = a.join(b, inside, "left_outer").withColumn("state", state)
    return out.select("job_id", "stage", "started_at", "ended_at", "state", F.when(F.col("state") == "completed", next_stage(F.col("stage"))).alias("next_stage"))


def leases(locked: DataFrame, beats: DataFrame, lease: str, late: str = "1 minute") -> DataFrame:
    """(job_id, locked_at, beat_at, action) from the streams ``locked`` (job_id, locked_at) and ``beats`` (job_id, beat_at): a row for each heartbeat within the
    lease (keep), and one for each lease without any (recover), told once both watermarks have passed its end. A renewed lock is a lease of its own."""
    a = _left(locked.select("job_id", "locked_at"), late, "locked_at")
    b = _left(beats.select(F.col("job_id").alias("__job"), "beat_at"), late, "beat_at")
    inside = (F.col("job_id") == F.col("__job")) & (F.col("beat_at") > F.col("locked_at")) & (F.col("beat_at") <= F.col("locked_at") + F.expr(f"interval {lease}"))
    return a.join(b, inside, "left_outer").select("job_id", "locked_at", "beat_at", F.when(F.col("beat_at").isNull(), "recover").otherwise("keep").alias("action"))
