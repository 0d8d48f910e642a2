"""Small helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that parts words: the blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
#: Measured bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows that one task sorts, about: ranges are made as fine as that takes.
RANGE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where none is set and all runs on this machine, as in tests,
    it is one of our own: executors elsewhere couldn't see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(at)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder, and read back: lineage is cut and statistics are kept."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def quoted(names) -> list[Column]:
    """Columns by their exact names, dots and back quotes included."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def _bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(column, F.lit(8), lambda acc, x: acc + _bytes(x, kind.elementType)), F.lit(8))
        return 8 + 8 * F.greatest(F.size(column), F.lit(0))
    if isinstance(kind, T.StructType):
        total = F.lit(8)
        for f in kind.fields:
            total = total + _bytes(column[f.name], f.dataType)
        return total
    return F.lit(8)


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` (a table that is already written), to be broadcast if its measured bytes are within ``most``; a
    shuffle join else."""
    size = F.lit(8)
    for column, f in zip(quoted(df.columns), df.schema.fields, strict=True):
        size = size + _bytes(column, f.dataType)
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= (BROADCAST_BYTES if most is None else most) else df


def word_array(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def id_fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def hex_digits(rows: int) -> int:
    """Leading hex digits of a digest that part so many rows into ranges of ``RANGE_ROWS`` at most; 3 at least."""
    return max(3, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 16)) if rows > RANGE_ROWS else 3)


def spelled_out(items: DataFrame, n: str, out: str, step: int = 10_000) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``out``. ``items`` is a written table; rows of large numbers are
    dealt over tasks by blocks of ``step``."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {step}")))
    number = F.explode(F.sequence(F.col("__block") * step, F.least(F.col(n), (F.col("__block") + 1) * step) - 1))
    few = items.where(F.col(n) <= step).withColumn("__block", F.lit(0).cast("long"))
    many = items.where(F.col(n) > step)
    if many.limit(1).count():
        few = few.unionByName(many.withColumn("__block", block).repartition("__block"))
    return few.withColumn(out, number).drop("__block")


def numbered(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """``rows`` numbered from 1 within equal ``by`` (nulls are equal), in no stated order: within each partition of
    a written copy, after the numbers of the partitions before. No group meets in one task."""
    at = checkpointed(rows.withColumn("__p", F.spark_partition_id()))
    from pyspark.sql import Window as W

    counts = at.groupBy(*by, "__p").agg(F.count("*").alias("__c"))
    before = W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("__s", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    starts = starts.select(*[F.col(c).alias(f"__{c}_") for c in by], F.col("__p").alias("__q"), "__s")
    match = F.col("__p") == F.col("__q")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}_"))
    own = F.row_number().over(W.partitionBy(*by, "__p").orderBy(F.lit(1)))
    return at.withColumn("__o", own).join(starts, match).withColumn(out, F.col("__s") + F.col("__o")).drop("__p", "__q", "__s", "__o", *[f"__{c}_" for c in by])
