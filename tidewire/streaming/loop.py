"""Streaming ingestion and delivery with files as tables.

Each micro-batch writes to a folder of its own number, so a batch that runs again after a failure
overwrites its own output instead of adding to it. Claims are written before a record is sent and never
retried: delivery is at most once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import store
from ..operators.keyed import KeyedTable
from ..sources.sinks import Transport, deliver


def stored(spark: SparkSession, path: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before a number."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schema)
    full = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")).schema
    rows = spark.read.schema(full).option("basePath", path).parquet(path)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def ingest(posts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each batch's posts that aren't stored yet, by key; of equal keys in a batch the earliest read."""

    def write(batch: DataFrame, number: int) -> None:
        old = stored(batch.sparkSession, path, posts.schema, number)
        new = store.insert_if_absent(batch, old, [F.col("scraped_at"), F.col("text")])
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")).start()


def ingest_table(posts: DataFrame, table: KeyedTable, checkpoint: str, name: str = "ingest", available_now: bool = True) -> StreamingQuery:
    """As ingest(), into a keyed table: a batch reads and writes only the parts that its posts fall into, so its time doesn't grow
    with the posts stored elsewhere. A batch that runs again after a failure isn't merged twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # merge() reads it for its parts and for its rows
        merge = lambda old, new: old.unionByName(store.insert_if_absent(new, old, [F.col("scraped_at"), F.col("text")]).select(*old.columns))
        table.merge(batch, merge, name, number)
        batch.unpersist()

    w = posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")).start()


def deliver_stream(cards: DataFrame, claims: str, checkpoint: str, transport: Transport, url: str, clock: Callable[[], str], secret: str | None = None) -> StreamingQuery:
    """Send each card (group_id, fingerprint, card) once: its claim is written first, and one that exists isn't sent again."""
    schema = "group_id string, fingerprint string"

    def send(batch: DataFrame, number: int) -> None:
        old = stored(batch.sparkSession, claims, schema)
        new = store.insert_if_absent(batch, old, [F.col("card")], ("group_id", "fingerprint"))
        rows = new.collect()  # cards of one batch: bounded by the call budget
        if not rows:
            return
        batch.sparkSession.createDataFrame([(r.group_id, r.fingerprint) for r in rows], schema).write.mode("append").parquet(f"{claims}/batch={number}")
        for r in rows:
            deliver(transport, url, r.card, clock(), secret)

    return cards.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
