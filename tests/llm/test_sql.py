"""Queries that SQL can express, against DuckDB."""

import pytest

from tests.oracle import both
from tidewire.llm import entries


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_query_equals_sql(spark, sf, name):
    got, want = both(spark, sf, entries.QUERIES[name], entries.SQL[name])
    assert got == want
