"""Gates, night alerts and night recaps as streams equal plain sequences, however the input is cut, and across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import admission, ranking
from tidewire.plans import queries_history
from tidewire.streaming import processors

BASE = 1_704_067_200


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    processors.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, folder, parts, operator):
    """Rows of all parts (data frames in order of `at`), each part one run of the query from its checkpoint."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{folder}/in").withWatermark("at", "0 seconds")
        out = operator(source)
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(200) and q.exception() is None
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def cuts(df, *seconds):
    """df in parts by time."""
    at = F.unix_micros("at") / 1e6
    edges = [float("-inf"), *seconds, float("inf")]
    return [df.where((at > a) & (at <= b)).orderBy("at") for a, b in zip(edges, edges[1:], strict=False)]


def plain_gates(rows, least, wait, quiet_wait, until):
    out, state = [], {}
    for g in sorted({r[0] for r in rows}):
        n, oldest, due = 0, None, None
        for at, urgent, quiet in sorted(r[1:] for r in rows if r[0] == g):
            if n and at >= due:
                out.append((g, n, oldest, due, "waited"))
                n = 0
            oldest = at if not n else oldest
            n, due = n + 1, oldest + (quiet_wait if quiet else wait)
            reason = "urgent" if urgent else "count" if n >= least and not quiet else "waited" if at >= due else None
            if reason:
                out.append((g, n, oldest, at, reason))
                n = 0
        if n and due <= until:
            out.append((g, n, oldest, due, "waited"))
    return sorted(out)


def test_gates(spark, tmp_path):
    rng = random.Random(11)
    times = rng.sample(range(4 * 3600), 220)
    rows = [(rng.choice("ab"), float(BASE + t), rng.random() < 0.04, 7200 <= t < 10_800) for t in times]
    end = BASE + 5 * 3600
    rows.append(("z", float(end), False, False))  # moves the watermark on
    df = spark.createDataFrame(rows, "group_id string, at_s double, urgent boolean, quiet boolean").withColumn("at", F.timestamp_micros((F.col("at_s") * 1e6).cast("long"))).drop("at_s")
    want = [w for w in plain_gates(rows, 5, 900, 1500, end - 0.001) if w[0] != "z"]
    assert {w[4] for w in want} == {"waited", "urgent", "count"}
    for k, parts in enumerate((cuts(df), cuts(df, BASE + 1800, BASE + 3000, BASE + 9001))):
        out = streamed(spark, tmp_path / str(k), parts, lambda s: processors.gate_stream(s, 5, 900, 1500))
        assert sorted((r.group_id, r.n, r.oldest_s, r.opened_s, r.reason) for r in out) == want


def test_a_timer_opens_a_gate_without_another_row_of_its_group(spark, tmp_path):
    schema = "group_id string, at timestamp, urgent boolean, quiet boolean"
    row = lambda g, s: spark.createDataFrame([(g, s, False, False)], "group_id string, s double, urgent boolean, quiet boolean").select("group_id", F.timestamp_seconds("s").alias("at"), "urgent", "quiet").to(spark.createDataFrame([], schema).schema)
    out = streamed(spark, tmp_path, [row("a", BASE + 10.0), row("b", BASE + 500.0), row("b", BASE + 1200.0)], lambda s: processors.gate_stream(s, 9, 600))
    assert sorted((r.group_id, r.n, r.opened_s, r.reason) for r in out) == [("a", 1, BASE + 610.0, "waited"), ("b", 1, BASE + 1100.0, "waited")]


def test_night_alerts(spark, sf, tmp_path):
    e = queries_history.views.events(spark, sf)
    rows = e.select(F.col("event_type").alias("group_id"), F.col("event_id").alias("id"), F.timestamp_seconds("at_s").alias("at"), "at_s", (F.col("value") > 150).alias("escalation"))
    want = {(r.group_id, r.id) for r in admission.night_alerts(rows, 7200).where("accepted").collect()}
    half = BASE + 14 * 86400 + 0.5
    out = streamed(spark, tmp_path, cuts(rows.drop("at_s"), half), lambda s: processors.night_alert_stream(s, 7200))
    assert len(out) == rows.count() and {(r.group_id, r.id) for r in out if r.accepted} == want


def test_night_recap(spark, sf, tmp_path):
    items = queries_history.night_items(spark, sf)
    tail = items.limit(1).withColumn("group_id", F.lit("z")).withColumn("at", F.timestamp_seconds(F.lit(BASE + 40 * 86400)))
    key = lambda r: (r.group_id, r.day, r.rank, r.channel, r.message_id, r.score)
    want = sorted(map(key, ranking.night_recap(items, "23:00-07:00", "Asia/Shanghai", 5).collect()))
    night = processors.Night("23:00-07:00", "Asia/Shanghai")
    parts = cuts(items, BASE + 9 * 86400 + 70_000.5, BASE + 20 * 86400 + 0.5) + [tail]
    out = streamed(spark, tmp_path, parts, lambda s: processors.night_recap_stream(s, night, 5))
    assert sorted(map(key, (r for r in out if r.group_id != "z"))) == want and len(want) > 100


def test_nights():
    n = processors.Night("23:00-07:00", "Asia/Shanghai")
    assert n.of(BASE) is None  # 08:00 there
    assert n.of(BASE + 15 * 3600) == ("2024-01-02", BASE + 23 * 3600.0) and n.of(BASE + 23 * 3600 - 1)[0] == "2024-01-02" and n.of(BASE + 23 * 3600) is None
    assert processors.Night("00:00-08:00", "UTC").of(BASE + 1)[0] == "2024-01-01"
    with pytest.raises(ValueError):
        processors.Night("")
