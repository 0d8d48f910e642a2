"""Queries over the tables, by group; importing a module registers its queries."""

from . import billing, control, extra, knowledge, recognition, relational, retrieval, texts, usage  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
