"""The event queue as a stream: claiming in micro-batches, retries and dead letters, idempotent appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def source(spark: SparkSession, folder: str, schema: StructType, files: int = 1, kind: str = "parquet") -> DataFrame:
    """A folder as a queue: a few files to a batch; offsets in the checkpoint stand for leases and locks."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handles all that is there, batch by batch, and stops; begun again, it goes on where it ended."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def after_attempts(events: DataFrame, outcomes: DataFrame, delay_seconds: int = 30, most: int = 5) -> DataFrame:
    """State of events after a batch of outcomes (event_id, ok, at): done, retry with a delay that grows with
    the attempts, or dead letter."""
    seen = outcomes.groupBy("event_id").agg(F.count_if(~F.col("ok")).alias("failed"), F.bool_or("ok").alias("ok"), F.max("at").alias("at"))
    rows = events.join(seen, "event_id", "left")
    attempts = F.col("attempts") + F.coalesce("failed", F.lit(0))
    status = F.when(F.col("ok"), "done").when(F.col("at").isNull(), F.col("status")).when(attempts >= most, "dead_letter").otherwise("retry")
    due = F.when(status == "retry", F.timestamp_seconds(F.unix_seconds(F.col("at").cast("timestamp")) + delay_seconds * attempts))
    return rows.select("event_id", status.alias("status"), attempts.alias("attempts"), due.alias("next_retry_at"))


def publish(new: DataFrame, stored: DataFrame, key: str = "idempotency_key", order: str = "event_id") -> DataFrame:
    """New events to append: the first of each key that isn't stored; events without a key are always appended."""
    keyed = new.where(F.col(key).isNotNull())
    first = keyed.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return first.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").unionByName(new.where(F.col(key).isNull()))
