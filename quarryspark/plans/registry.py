"""Queries by name, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: "Now" in all queries: the tables are of January 2024.
NOW = "2024-01-30 00:00:00"


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its own name."""

    def register(function):
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        QUERIES[name].__name__, QUERIES[name].__doc__ = name, function.__doc__
        if sql:
            SQL[name] = sql
        return function

    return register


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def long(column: Column) -> Column:
    return column.cast("long")
