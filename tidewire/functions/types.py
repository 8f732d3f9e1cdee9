"""Schemas from short texts, without a session (workers import modules that define UDFs)."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def struct(columns: str) -> T.StructType:
    """'a string, b long' as a struct type."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split(" ", 1) for c in columns.split(", "))])
