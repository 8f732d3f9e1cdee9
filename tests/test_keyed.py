"""Keyed tables: partial updates, versions, conflicts, a writer that dies, and ingestion that touches few parts."""

import pytest

from tidewire.operators import keyed, store
from tidewire.streaming import loop

SCHEMA = "group_id string, channel string, message_id long, text string, scraped_at timestamp"


def rows(spark, *ids, text="a", channel="c"):
    return spark.createDataFrame([("g", channel, i, text, None) for i in ids], SCHEMA)


def upsert(old, new):
    return old.join(new, list(store.KEY), "left_anti").unionByName(new)


def ids(df):
    return sorted((r.message_id, r.text) for r in df.collect())


def test_an_update_rewrites_only_the_parts_it_touches(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, keyed.by_post())
    assert t.version() == 0 and t.read().count() == 0
    assert t.merge(rows(spark, 1, 2, 15_000, 25_000), upsert) == 1
    first = t.manifest(1)["parts"]
    assert t.merge(rows(spark, 2, 3, text="b"), upsert) == 2
    second = t.manifest(2)["parts"]
    assert len(first) == 3 and sum(first[p] != second[p] for p in first) == 1
    want = [(1, "a"), (2, "b"), (3, "b"), (15_000, "a"), (25_000, "a")]
    assert ids(t.read()) == want and ids(t.read(1)) == [(1, "a"), (2, "a"), (15_000, "a"), (25_000, "a")]
    snapshot = t.read(2)  # a pass goes on seeing its version while others write
    t.merge(rows(spark, 15_000), lambda old, new: old.join(new, list(store.KEY), "left_anti"))  # a part becomes empty
    assert ids(snapshot) == want and ids(t.read()) == [r for r in want if r[0] != 15_000] and len(t.manifest(3)["parts"]) == 2
    assert t.forget(keep=1) >= 1 and ids(t.read()) == [r for r in want if r[0] != 15_000]
    with pytest.raises(Exception, match="1.json"):
        t.manifest(1)


def test_a_writer_that_dies_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, keyed.by_post())
    t.merge(rows(spark, 1), upsert)

    def dies(self, version, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_commit", dies)
        with pytest.raises(RuntimeError):
            t.merge(rows(spark, 1, text="b"), upsert)
    assert t.version() == 1 and ids(t.read()) == [(1, "a")]
    assert t.merge(rows(spark, 1, text="c"), upsert) == 2 and ids(t.read()) == [(1, "c")]
    assert t.forget(keep=2) == 1  # the folder that it left


def test_two_writers_keep_each_others_rows(spark, tmp_path):
    a, b = (keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, keyed.by_post()) for _ in "ab")
    asked = []

    def slow(old, new):
        if not asked:  # the other writer is faster
            b.merge(rows(spark, 2, text="b"), upsert)
        asked.append(sorted(r.message_id for r in old.collect()))
        return upsert(old, new)

    assert a.merge(rows(spark, 1), slow) == 2
    assert asked == [[], [2]] and ids(a.read()) == [(1, "a"), (2, "b")]


def test_ingestion_doesnt_rescan_what_is_stored(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, keyed.by_post())
    touched = []
    read = t.read
    t.read = lambda version=None, parts=None: touched.append(parts) or read(version, parts)
    for k in range(4):
        rows(spark, *range(k * 10_000 + 10, k * 10_000 + 14), *range(k * 10_000 + 12, k * 10_000 + 16)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = loop.ingest_table(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), t, f"{tmp_path}/ck")
        assert q.awaitTermination(120) and q.exception() is None
    assert read().count() == 24 and [len(p) for p in touched] == [1] * 4  # one part a batch, however many are stored
    # a batch that is in the table already isn't merged again
    assert t.merge(rows(spark, 1), upsert, "ingest", 3) == t.version() == 4 and read().where("message_id = 1").count() == 0


def test_usage_and_schedule(spark):
    calls = spark.createDataFrame([("g", 1, None), ("g", 2, 5), ("h", 1, 7)], "group_id string, started long, tokens long")
    usage = spark.createDataFrame([("g", 1, 9), ("g", 1, 4), ("g", 2, None), ("x", 1, 3)], calls.schema)
    assert sorted((r.group_id, r.started, r.tokens) for r in store.record_usage(calls, usage).collect()) == [("g", 1, 9), ("g", 2, 5), ("h", 1, 7)]
    stored = spark.createDataFrame([("a", 3, "day")], "group_id string, quiet_cards_sent int, last_mode string")
    groups = spark.createDataFrame([("a",), ("b",), ("b",)], "group_id string")
    assert sorted(map(tuple, store.schedule_rows(groups, stored).collect())) == [("a", 3, "day"), ("b", 0, None)]
