"""The engine's relations as views of the supplied tables, and the same in DuckDB SQL.

Times are seconds since 1970 in query results, so that no session setting changes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1704067200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.when(F.col("lang") == "en", "news24").otherwise("intl").alias("group_id"),
        F.col("source").alias("channel"),
        F.col("doc_id").alias("message_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.timestamp_seconds(START + F.col("doc_id") * 60).alias("published_at"),
        F.timestamp_seconds(START + (F.col("doc_id") + F.col("doc_id") % 7) * 60).alias("scraped_at"),
    )


POSTS = f"""posts AS (SELECT CASE WHEN lang = 'en' THEN 'news24' ELSE 'intl' END AS group_id, source AS channel, doc_id AS message_id,
  coalesce(text, '') AS text, {START} + doc_id * 60 AS published_s, {START} + (doc_id + doc_id % 7) * 60 AS scraped_s FROM documents)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a column known: whether the post is a stored one, which are those with a label."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), F.lit(True).alias("known")).distinct()
    return posts(spark, sf_dir).join(labelled, "message_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.extract(F.lit("SECOND"), ts)).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("at_s", seconds(F.col("ts").cast("timestamp_ntz")))


EVENTS = "ev AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("group_id"), F.col("event_id").alias("id"), "at_s", F.when(F.col("event_id") % 5 == 0, None).otherwise(F.floor("value")).cast("long").alias("tokens"))


CALLS = "calls AS (SELECT event_type AS group_id, event_id AS id, at_s, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS tokens FROM ev)"


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.lit("g").alias("group_id"), F.col("user_id").cast("string").alias("channel"), "at_s", F.timestamp_seconds("at_s").alias("at"), F.col("event_id").alias("ord"),
        (F.col("event_type") != "error").alias("success"), F.col("event_id").alias("message_id"), F.lit(1).cast("long").alias("seen"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
    )
