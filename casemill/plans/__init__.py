"""Queries of the library bound to tables, with the same result as SQL text."""

from __future__ import annotations

from . import counsel_queries, field_queries, graph_queries, search_queries, source_queries, store_queries, stream_queries  # noqa: F401  # they register their queries
from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
