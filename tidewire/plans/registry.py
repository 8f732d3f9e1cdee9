"""Registered queries, and helpers that write the same inline rows and patterns for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with the DuckDB SQL for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(literal, v)) + "]::VARCHAR[]"
    return str(v)


def rows_sql(name: str, columns: str, rows: Sequence[tuple]) -> str:
    """A DuckDB common table expression of inline rows; columns as in a Spark schema text."""
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
    names, types = zip(*(c.split(" ", 1) for c in columns.split(", ")), strict=True)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {kinds[t]}) AS {n}" for n, t in zip(names, types, strict=True))
    return f"{name} AS (SELECT {cast} FROM (VALUES {body}) AS v({', '.join(names)}))"


def duck(*patterns: str) -> str:
    """A quoted RE2 pattern that stands for Unicode word boundaries by explicit classes."""
    out = "|".join(f"(?:{p})" for p in patterns)
    out = re.sub(r"(^|[(|:])\\b", lambda m: m[1] + r"(?:^|[^\p{L}\p{N}_])", out)
    return literal("(?i)" + out.replace(r"\b", r"(?:[^\p{L}\p{N}_]|$)"))
