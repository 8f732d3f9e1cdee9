"""Streaming operators decide as the batch ones do, across restarts."""

from pyspark.sql import functions as F

from tidewire.operators import admission
from tidewire.plans import views
from tidewire.streaming import loop, state


def test_claims_across_restarts(spark, sf, tmp_path):
    e = views.events(spark, sf).orderBy("at_s", "event_id")
    rows = e.select(F.col("event_type").alias("group_id"), F.col("event_id").alias("id"), F.col("at_s").alias("claimed_s"), F.array(F.col("user_id").cast("string")).alias("fingerprints"))
    want = {(r.group_id, r.id) for r in admission.paired_claims(rows).where("accepted").collect()}
    middle = rows.approxQuantile("claimed_s", [0.5], 0.0)[0]
    got = set()
    for k, part in enumerate((rows.where(F.col("claimed_s") <= middle), rows.where(F.col("claimed_s") > middle))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in").drop("part")
        q = state.claim_stream(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {(r.group_id, r.id) for r in spark.read.parquet(f"{tmp_path}/out").where("accepted").collect()}
    assert got == want


def test_ingest_and_delivery_are_idempotent(spark, tmp_path):
    schema = "group_id string, channel string, message_id long, text string, scraped_at timestamp"
    rows = [("g", "c", 1, "a"), ("g", "c", 1, "b"), ("g", "c", 2, "x")]
    for k in range(2):
        spark.createDataFrame([(*r, None) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = loop.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/posts", f"{tmp_path}/ck")
        assert q.awaitTermination(120)
        assert loop.stored(spark, f"{tmp_path}/posts", schema).count() == 2

    class Transport:
        sent = []

        def post(self, url, body, headers):
            self.sent.append(body)
            return 200, '{"code": 0}'

    for k in range(2):
        spark.createDataFrame([("g", "f1", '{"k": 1}'), ("g", "f2", '{"k": 2}')], "group_id string, fingerprint string, card string").write.mode("append").parquet(f"{tmp_path}/cards")
        stream = spark.readStream.schema("group_id string, fingerprint string, card string").parquet(f"{tmp_path}/cards")
        q = loop.deliver_stream(stream, f"{tmp_path}/claims", f"{tmp_path}/ck2", Transport(), "u", lambda: "1")
        assert q.awaitTermination(120)
    assert len(Transport.sent) == 2
