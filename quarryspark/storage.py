"""Where intermediate tables are kept, and what is small enough to be broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measured bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir``, its lineage cut. Only where none is set and all runs on this
    machine, as in tests, the folder is one of our own: executors elsewhere couldn't see it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def measured_bytes(df: DataFrame) -> int:
    """About the bytes of a table, by the JSON of its rows; it is read once for that."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` to be broadcast if its measured bytes are within ``most``; a shuffle join else."""
    return F.broadcast(df) if measured_bytes(df) <= most else df
