"""All registered queries of the engine."""

from __future__ import annotations

from . import queries_filters, queries_history, queries_messages, queries_more, queries_records, queries_small, queries_tables  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
