"""The cleaning chain of document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once: the optimizer doesn't write a generator's expression into
    the places that use it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def normalise(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Encoding, page-number lines, repeated short lines, consecutive repeats, white space, in this order; no shuffle."""
    rows = held(docs, "__lines", X.without_page_numbers(F.split(X.fix_encoding(F.col(text)), "\n")))
    rows = held(rows, "__again", X.repeated_short_lines(F.col("__lines")))
    rows = held(rows, "__kept", X.without_lines(F.col("__lines"), F.col("__again")))
    rows = held(rows, "__left", X.without_consecutive_repeats(F.col("__kept")))
    return rows.withColumn(out, X.collapse_whitespace(F.array_join("__left", "\n"))).drop("__lines", "__again", "__kept", "__left")


def normalisation_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """How many lines each step takes from each text."""
    rows = held(docs.select(key, F.split(X.fix_encoding(F.col(text)), "\n").alias("__all")), "__lines", X.without_page_numbers(F.col("__all")))
    rows = held(rows, "__again", X.repeated_short_lines(F.col("__lines")))
    rows = held(rows, "__kept", X.without_lines(F.col("__lines"), F.col("__again")))
    rows = held(rows, "__left", X.without_consecutive_repeats(F.col("__kept")))
    less = lambda a, b: F.size(a) - F.size(b)
    return rows.select(key, less("__all", "__lines").alias("page_numbers"), less("__lines", "__kept").alias("repeated"), less("__kept", "__left").alias("consecutive"))
