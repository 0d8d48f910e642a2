"""Recognisers by name behind one table function: all give mentions with offsets, in SQL as in DataFrames.

A recogniser is an object with ``find(text, language)`` that yields ``Mention``s. ``register`` makes a table function of a set of them,
for ``SELECT ... FROM texts, LATERAL mentions(text, lang, 'company,identifier')``: kinds are checked when the query is analysed, texts aren't
shuffled. What a document's chunks have in common is grouped afterwards (``by_document``), where equal names meet by partial aggregates; a
table argument with PARTITION BY would bring all chunks of a document, however many, to one task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.companies import CONFIDENCE, FORMS, CompanyFinder
from .folds import person_names
from .text import IDENTIFIERS


class Mention(NamedTuple):
    kind: str
    subtype: str | None
    name: str
    start: int
    end: int
    confidence: float
    normalized: str


class Recogniser(Protocol):
    def find(self, text: str, language: str | None) -> Iterator[Mention]: ...


def _normal(name: str) -> str:
    return " ".join(name.lower().split())


class Companies:
    """Names before a legal form."""

    def __init__(self, forms: Mapping[str, Sequence[str]] = FORMS, known: Sequence[str] = ()):
        self.forms, self.known, self.finder = dict(forms), tuple(known), None

    def find(self, text: str, language: str | None) -> Iterator[Mention]:
        if self.finder is None:  # made in the worker
            self.finder = CompanyFinder(self.forms, known=self.known)
        for x in self.finder(text, language):
            yield Mention("company", x.legal_form, x.name, x.start, x.end, CONFIDENCE, x.normalized)


class Identifiers:
    """Mail addresses, telephone numbers, links, tickets, contracts and invoices."""

    def __init__(self, patterns: Mapping[str, str] = IDENTIFIERS, confidence: float = 0.9):
        self.patterns, self.confidence, self.compiled = dict(patterns), confidence, None

    def find(self, text: str, language: str | None) -> Iterator[Mention]:
        if self.compiled is None:
            self.compiled = {k: regex.compile(p, regex.V1) for k, p in self.patterns.items()}
        for kind, pattern in self.compiled.items():
            for m in pattern.finditer(text):
                yield Mention("identifier", kind, m[0], *m.span(), self.confidence, _normal(m[0]))


class Persons:
    """Capitalised pairs with a given name."""

    def __init__(self, given: Sequence[str], listed: Sequence[str] = ()):
        self.given, self.listed = frozenset(x.lower() for x in given), frozenset(x.lower() for x in listed)

    def find(self, text: str, language: str | None) -> Iterator[Mention]:
        for name, start, end, confidence in person_names(text, self.given, self.listed):
            yield Mention("person", None, name, start, end, confidence, _normal(name))


SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("kind", T.StringType()), ("subtype", T.StringType()), ("name", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("confidence", T.DoubleType()), ("normalized", T.StringType()))])


@dataclass
class Chosen(AnalyzeResult):
    """What the analysis tells the tasks."""

    kinds: tuple[str, ...] = ()


def _table_function(recognisers: Mapping[str, Recogniser]):
    known = dict(recognisers)

    class Mentions:
        def __init__(self, chosen: Chosen):
            self.chosen = [known[k] for k in chosen.kinds]

        @staticmethod
        def analyze(text: AnalyzeArgument, language: AnalyzeArgument, kinds: AnalyzeArgument) -> Chosen:
            for name, x in (("text", text), ("language", language)):
                if not isinstance(x.dataType, T.StringType | T.NullType):
                    raise ValueError(f"{name} is a {x.dataType.simpleString()}, not a string")
            if not kinds.isConstantExpression or not kinds.value:
                raise ValueError("kinds are a constant list of names, parted by commas")
            names = tuple(dict.fromkeys(k.strip() for k in kinds.value.split(",")))
            if unknown := [k for k in names if k not in known]:
                raise ValueError(f"no recogniser is called {', '.join(unknown)}; there are {', '.join(sorted(known))}")
            return Chosen(schema=SCHEMA, kinds=names)

        def eval(self, text: str | None, language: str | None, kinds: str) -> Iterator[Mention]:
            for one in self.chosen if text else ():
                yield from one.find(text, language)

    return F.udtf(Mentions)


def register(spark: SparkSession, recognisers: Mapping[str, Recogniser], name: str = "mentions"):
    """A table function of the recognisers, by name for SQL; returned for DataFrames."""
    return spark.udtf.register(name, _table_function(recognisers))


def recognised(texts: DataFrame, keep: Sequence[str], text: str, language: str, recognisers: Mapping[str, Recogniser]) -> DataFrame:
    """Columns ``keep`` and those of ``SCHEMA``: the mentions of all recognisers in each text. Null or empty texts have none; equal rows are
    searched apart. A name in ``keep`` that ``SCHEMA`` has too is refused (``ValueError``)."""
    if clash := set(keep) & set(SCHEMA.names):
        raise ValueError(f"columns {', '.join(sorted(clash))} are those of mentions")
    call = _table_function(recognisers)
    rows = texts.select(*keep, F.col(text).alias("__text"), F.col(language).cast("string").alias("__language"))
    found = call(F.col("__text").outer(), F.col("__language").outer(), F.lit(",".join(recognisers)))
    return rows.lateralJoin(found).select(*keep, *SCHEMA.names)


def by_document(mentions: DataFrame, document: str, chunk: str) -> DataFrame:
    """(document, kind, normalized, name, chunk, start, n, confidence): each thing of a document once, as written and placed at its first mention (by chunk,
    then start, then name), with the number of mentions and the most confidence."""
    first = F.min(F.struct(F.col(chunk), F.col("start"), F.col("name"))).alias("__first")
    rows = mentions.groupBy(document, "kind", "normalized").agg(first, F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    return rows.select(document, "kind", "normalized", "__first.name", f"__first.{chunk}", "__first.start", "n", "confidence")
