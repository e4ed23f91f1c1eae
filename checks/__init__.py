"""Registered queries: each operator over whole tables, with SQL that must agree."""

from checks.base import QUERIES, SQL
from checks import sources, sinks, rows, matching, profiles, ranking, text, vectors, retrieval, streams  # noqa: F401

__all__ = ["QUERIES", "SQL"]
