"""Queries over the history of channels and of nights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, ranking, store
from . import views
from .registry import query

#: Hosts of the pages are the channels, their numbers the posts; posts with a label are the stored ones.
M = """m AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS channel, page_id, page_id IN (SELECT doc_id FROM labels) AS known FROM pages),
    c AS (SELECT channel, list(page_id ORDER BY page_id DESC) AS ids, list(known ORDER BY page_id DESC) AS ks FROM m GROUP BY 1)"""


def channel_posts(spark, sf_dir):
    labelled = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), F.lit(True).alias("known")).distinct()
    p = views.table(spark, sf_dir, "pages").select(F.lit("g").alias("group_id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("channel"), F.col("page_id").alias("message_id"))
    return p.join(labelled, "message_id", "left")


def _walk(size: int, pages: int, most: int) -> str:
    """One step a page: the walk carries the posts found so far."""
    fresh = f"list_filter(list_zip(ids[{size} * page + 1:{size} * (page + 1)], ks[{size} * page + 1:{size} * (page + 1)]), lambda x: NOT x[2])"
    return f"""WITH RECURSIVE {M}, w AS (
      SELECT channel, ids, ks, 0 AS page, CAST(0 AS BIGINT) AS before, {fresh.replace('page', '0')} AS fresh FROM c
      UNION ALL SELECT channel, ids, ks, page, before, {fresh} AS fresh FROM (
        SELECT channel, ids, ks, page + 1 AS page, before + len(fresh) AS before FROM w
        WHERE (len(fresh) > 0 OR page = 0) AND page + 1 < {pages} AND len(ids) > {size} * (page + 1) AND before + len(fresh) < {most}))
    SELECT channel, page, unnest(fresh[1:{most} - before])[1] AS message_id FROM w"""


@query(_walk(4, 5, 1_000_000_000))
def src3_history_walk(spark, sf_dir):
    """New posts of each channel by pages of four, five at most."""
    return history.walked(channel_posts(spark, sf_dir), 4, 5).select("channel", "page", "message_id")


@query(_walk(3, 50, 17))
def src3_history_walk_capped(spark, sf_dir):
    """The same by pages of three, with at most 17 new posts a channel."""
    return history.walked(channel_posts(spark, sf_dir), 3, 50, 17).select("channel", "page", "message_id")


@query(
    f"""WITH {views.EVENTS}, n AS (SELECT event_type AS group_id, CAST(user_id AS VARCHAR) AS channel, event_id % 50 AS message_id, at_s, CAST(value AS INTEGER) % 10 + 1 AS score, CAST(user_id % 7 AS VARCHAR) AS fp,
        epoch(ts) AS exact, (at_s + 28800) % 86400 AS second, strftime(make_timestamp((at_s + 28800) * 1000000), '%Y-%m-%d') AS today, strftime(make_timestamp((at_s + 28800 + 86400) * 1000000), '%Y-%m-%d') AS tomorrow FROM ev),
      d AS (SELECT *, CASE WHEN second >= 82800 THEN tomorrow ELSE today END AS day FROM n WHERE second >= 82800 OR second < 25200),
      l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY group_id, day, channel, message_id ORDER BY exact DESC, score DESC, fp DESC) = 1),
      o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY group_id, day, fp ORDER BY score DESC, exact DESC, channel, message_id) = 1)
    SELECT group_id, day, CAST(row_number() OVER (PARTITION BY group_id, day ORDER BY score DESC, exact DESC, channel, message_id) AS INTEGER) AS rank, channel, message_id, score FROM o
    QUALIFY row_number() OVER (PARTITION BY group_id, day ORDER BY score DESC, exact DESC, channel, message_id) <= 5"""
)
def str7_night_recap(spark, sf_dir):
    """The five best items of each group's nights, 23:00 to 07:00 in Shanghai."""
    return ranking.night_recap(night_items(spark, sf_dir), "23:00-07:00", "Asia/Shanghai", 5)


def night_items(spark, sf_dir):
    e = views.events(spark, sf_dir)
    exact = F.timestamp_micros((F.col("at_s") * 1_000_000 + F.date_format(F.col("ts").cast("timestamp_ntz"), "SSSSSS").cast("long")))
    return e.select(
        F.col("event_type").alias("group_id"), F.col("user_id").cast("string").alias("channel"), (F.col("event_id") % 50).alias("message_id"), exact.alias("at"),
        (F.rint("value").cast("int") % 10 + 1).alias("score"), (F.col("user_id") % 7).cast("string").alias("fingerprint"),
    )


@query(
    f"""WITH {views.EVENTS}, {views.CALLS}, u AS (SELECT event_type AS group_id, event_id AS id, max(CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id * 10 END) AS told FROM ev WHERE event_id % 3 = 0 GROUP BY 1, 2)
    SELECT group_id, count(*) AS calls, sum(coalesce(told, tokens)) AS tokens, count(*) FILTER (coalesce(told, tokens) IS NULL) AS unknown FROM calls LEFT JOIN u USING (group_id, id) GROUP BY 1"""
)
def sup3_token_usage(spark, sf_dir):
    """Calls, tokens and calls of unknown usage of each group, after usage came in for a third of the calls."""
    e = views.events(spark, sf_dir)
    usage = e.where("event_id % 3 = 0").select(F.col("event_type").alias("group_id"), F.col("event_id").alias("id"), F.when(F.col("user_id") % 4 != 0, F.col("user_id") * 10).alias("tokens"))
    calls = store.record_usage(views.calls(spark, sf_dir), usage, ("group_id", "id"))
    return calls.groupBy("group_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("unknown"))


@query(
    f"""WITH {views.EVENTS}, s AS (SELECT CAST(user_id AS VARCHAR) AS group_id, count(*) AS quiet_cards_sent, max(at_s) AS last_mode_at FROM ev WHERE event_type = 'purchase' AND user_id % 3 = 0 GROUP BY 1),
    g AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS group_id FROM ev) SELECT group_id, coalesce(quiet_cards_sent, 0) AS quiet_cards_sent, last_mode_at FROM g LEFT JOIN s USING (group_id)"""
)
def sup5_schedule_rows(spark, sf_dir):
    """A schedule row for every user: the stored one of some, a new one for the others."""
    e = views.events(spark, sf_dir).withColumn("group_id", F.col("user_id").cast("string"))
    stored = e.where("event_type = 'purchase' AND user_id % 3 = 0").groupBy("group_id").agg(F.count("*").alias("quiet_cards_sent"), F.max("at_s").alias("last_mode_at"))
    return store.schedule_rows(e, stored)
