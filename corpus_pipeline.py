"""The corpus pipeline: documents -> good, distinct, decontaminated, mixed, sharded documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet and
read again. All but the last return the columns of ``documents``; the last adds shard and slot. Columns are kept
whatever their names; of an empty table every stage returns an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarryspark.llm import decontaminate, mixing, quality, sharding, similar
from quarryspark.llm.common import shared_dir
from quarryspark.packaging import ship

#: Documents that score less are rejected.
MIN_QUALITY = 0.3


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least ``MIN_QUALITY``. A null text is an empty one; rows of
    one text share their fate, whatever their id; without labels of both kinds all are scored alike."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, "__score").where(f"__score >= {MIN_QUALITY}").drop("__score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more, found by the Golay codes of
    fingerprints and, for what is further apart, by min-wise keys. The row of the smallest id stays, a null id after all others; null and blank texts are copies of each other."""
    return similar.deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and blank texts have none. A null id saves no row, and
    other rows of a removed id stay if their text is clean."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, whole; texts without words stay once, a null source is one of
    its own, and repeated rows are taken each for itself."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it, copies and repeated rows each with a slot of its own."""
    return sharding.sharded_documents(docs)


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [(name, _shipped(stage)) for name, stage in (("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded))]

#: The quality model is fitted, which SQL can't express; tests/llm/test_pipeline.py has brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the tables between are in the shared checkpoint folder."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
