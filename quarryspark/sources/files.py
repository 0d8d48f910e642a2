"""Sources and sinks: texts, uploads by type, dictionaries, tables."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import upsert


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as UTF-8, ill-formed bytes replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def sniff(content: Column) -> Column:
    """Type of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 512))
    zero = head.rlike("^(?:..)*?00")
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(zero, "binary").when(F.is_valid_utf8(content.cast("string")), "text").otherwise("binary")


def _docx_parts(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of the paragraphs and table rows of a word-processor file, in order."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    texts = lambda node: "".join(t.text or "" for t in node.iter(f"{ns}t"))
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{ns}p" and (text := texts(node).strip()):
            out.append(("paragraph", text))
        elif node.tag == f"{ns}tbl":
            out += [("table_row", " | ".join(texts(cell).strip() for cell in row.iter(f"{ns}tc"))) for row in node.iter(f"{ns}tr")]
    return out


_PARTS = T.StructType([T.StructField(n, k) for n, k in (("path", T.StringType()), ("part_index", T.IntegerType()), ("kind", T.StringType()), ("text", T.StringType()), ("error", T.StringType()))])


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, part_index, kind, text, error): uploads by extension, txt or docx; others are reported as an error."""

    def run(frames):
        for pdf in frames:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                try:
                    if kind == "txt":
                        rows.append((name, 0, "text", bytes(content).decode("utf-8", "replace"), None))
                    elif kind == "docx":
                        rows += [(name, i, k, t, None) for i, (k, t) in enumerate(_docx_parts(bytes(content)))]
                    else:
                        rows.append((name, 0, None, None, f"unsupported type {kind}"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((name, 0, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=_PARTS.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _PARTS)


def archive_problems(entries: DataFrame, most_entries: int, most_bytes: int, most_ratio: float) -> DataFrame:
    """Archives (path; one row for each entry's size and compressed size) that break a limit."""
    s = entries.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("compressed").alias("compressed"))
    why = F.when(F.col("n") > most_entries, "too many entries").when(F.col("size") > most_bytes, "too large").when(F.col("size") > most_ratio * F.greatest("compressed", F.lit(1)), "ratio too high")
    return s.select("path", why.alias("problem")).where(F.col("problem").isNotNull())


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Name lists: comments skipped, text from ";" on and quotes cut off, letters only and at least two, once each."""
    name = F.trim(F.regexp_replace(F.substring_index("value", ";", 1), "[\"']", ""))
    return spark.read.text(path).where(~F.trim("value").startswith("#")).select(name.alias("name")).where(F.col("name").rlike(r"^\p{L}{2,}$")).distinct()


def read_nicknames(spark: SparkSession, path: str) -> DataFrame:
    """(name, aliases) from lines of comma-separated names, the first being the canonical one."""
    parts = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 1).select(F.get("p", F.lit(0)).alias("name"), F.slice("p", F.lit(2), F.size("p") - 1).alias("aliases"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, weight, markers) from JSON lines."""
    return spark.read.schema("topic string, weight double, markers array<string>").json(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``rows`` holds, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_table(new: DataFrame, path: str, key: list[str], version: str, out: str) -> None:
    """Writes old and new rows, the newest of each key, to another place."""
    spark = new.sparkSession
    upsert(spark.read.parquet(path), new, key, version).write.mode("overwrite").parquet(out)


def json_lines(rows: DataFrame, path: str, most: int | None = None) -> None:
    (rows.limit(most) if most else rows).write.mode("overwrite").json(path)


def name_pattern(names: list[str]) -> str:
    return "(?iu)(?<![\\p{L}])(?:" + "|".join(re.escape(n) for n in names) + ")(?![\\p{L}])"
