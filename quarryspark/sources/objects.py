"""Objects by key, kept as a table; and tables of many tenants, one folder each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an object besides its bytes.
FACTS = ("key", "content_type", "size", "version")


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def safe_segment(value: Column) -> Column:
    """A part of a key: trimmed, runs of slashes made "_"; null where nothing is left, or it would name a folder."""
    cleaned = F.regexp_replace(_trimmed(value), r"[/\\]+", "_")
    return F.when(~cleaned.isin("", ".", ".."), cleaned)


def safe_filename(name: Column) -> Column:
    """A file's name in a key: as given if it is ASCII, else 16 digits of its digest and the extension."""
    cleaned = F.nullif(F.regexp_replace(_trimmed(name), r"[/\\]+", "_"), F.lit(""))
    ending = F.lower(F.regexp_extract(cleaned, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))
    return F.when(cleaned.rlike(r"^[\x00-\x7f]*$"), cleaned).otherwise(F.concat(F.substring(F.sha2(cleaned.cast("binary"), 256), 1, 16), ending))


def training_key(tenant: Column, knowledge_base: Column, batch: Column, item: Column, filename: Column | None = None) -> Column:
    """The key of an uploaded file, or of a text without one; null if a part is unusable. No tenant is "default"."""
    owner = safe_segment(F.coalesce(F.nullif(tenant, F.lit("")), F.lit("default")))
    last = F.lit("input.txt") if filename is None else safe_filename(filename)
    parts = [F.lit("tenants"), owner, F.lit("kb"), safe_segment(knowledge_base), F.lit("training"), safe_segment(batch), safe_segment(item), last]
    return F.when(~F.exists(F.array(*parts), lambda x: x.isNull()), F.array_join(F.array(*parts), "/"))


def put_objects(rows: DataFrame, path: str, version: int) -> None:
    """Appends objects (key, content_type, content): many to a file, so that their number doesn't burden the file
    system. A later version of a key stands for the earlier ones."""
    facts = rows.select("key", "content_type", F.octet_length("content").cast("long").alias("size"), F.lit(version).cast("long").alias("version"), "content")
    facts.where("key IS NOT NULL").write.mode("append").parquet(path)


def stat_objects(spark: SparkSession, path: str) -> DataFrame:
    """(key, content_type, size, version) of each key's newest object; no bytes are read."""
    newest = F.max_by(F.struct(*FACTS), "version").alias("x")
    return spark.read.parquet(path).select(*FACTS).groupBy("key").agg(newest).select("x.*")


def get_objects(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """(key, content) of the newest objects of the keys in ``refs``; null bytes for keys that there aren't. Versions
    are settled on the narrow columns first, so that only wanted bytes are shuffled."""
    wanted = refs.select("key").distinct()
    found = stat_objects(spark, path).join(wanted, "key", "left_semi").select("key", "version")
    held = spark.read.parquet(path).join(found, ["key", "version"], "left_semi").groupBy("key").agg(F.first("content").alias("content"))
    return wanted.join(held, "key", "left")


def scan_tenants(spark: SparkSession, root: str, table: str, schema: str, tenants: list[str] | None = None) -> DataFrame:
    """One table of all tenants, or of those named: ``root/<tenant>/<table>`` with a column ``tenant``. One scan; a
    list of tenants bounds what is listed and read; a tenant without the table has no rows, but one at least must have it."""
    pattern = "{" + ",".join(sorted(set(tenants))) + "}" if tenants else "*"
    rows = spark.read.schema(schema).option("basePath", root).option("ignoreMissingFiles", "true").parquet(f"{root}/{pattern}/{table}")
    return rows.withColumn("tenant", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/" + table + r"/[^/]*$", 1))
