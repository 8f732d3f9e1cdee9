"""Every registered query against DuckDB, on the smallest tables."""

import pytest

from tests.oracle import both
from tidewire.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    got, want = both(spark, sf, queries.QUERIES[name], queries.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_give_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stored_side_of_item_joins_is_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    convs = {r.conv_id for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().collect()}
    assert {r.message_id for r in queries.QUERIES["jn6_outcome"](spark, sf).collect()} == ids
    assert {r.message_id for r in queries.QUERIES["jn4_first_known_item"](spark, sf).collect()} == ids & convs
    assert {r.item for r in queries.QUERIES["jn5_item_to_post"](spark, sf).collect()} == ids & convs


def test_digest_candidates_come_from_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got, want = both(spark, sf, queries.QUERIES["pending_digest_candidates"], queries.SQL["pending_digest_candidates"])
    column = sorted(["group_id", "channel", "message_id", "fingerprint", "rank"]).index("message_id")
    assert got == want and max(r[column] for r in got) > 602


def test_summaries_are_polished_and_shortened_whole(spark):
    """Every turn's whole text, none cut before it is polished, and both columns of each."""
    sf = "/root/testdata/sf0.1"
    got, want = both(spark, sf, queries.QUERIES["strf20_summaries"], queries.SQL["strf20_summaries"])
    assert got == want and len(got[0]) == 3  # id, polished, shortened
    texts = spark.read.parquet(f"{sf}/conversations.parquet").where("turn % 3 = 2 AND length(text) > 60").count()
    long = queries.QUERIES["strf20_summaries"](spark, sf).where("id >= 1000 AND id % 100 % 3 = 2 AND length(polished) > 61").count()
    assert long == texts > 0
