"""Queries over prompts, groups, set operations, retention and delays."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import cards, mathfn, prompts, timewin
from ..operators import ranking, store
from . import views
from .queries_filters import KNOWN, LOCAL, local_events, strip
from .registry import query

POSTS = views.POSTS
_SIDES = f"a AS (SELECT DISTINCT channel, group_id FROM posts WHERE {KNOWN}), b AS (SELECT DISTINCT channel, group_id FROM posts WHERE NOT {KNOWN} AND message_id % 3 = 0)"


@query(
    f"""WITH {POSTS}, {_SIDES} SELECT 'union' AS kind, * FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', * FROM (FROM a INTERSECT FROM b)
    UNION ALL SELECT 'except', * FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'union_all', * FROM (FROM a UNION ALL FROM b)"""
)
def set2_table_operations(spark, sf_dir):
    """Channels of the stored posts and of a third of the others: together, in both, and in the first alone."""
    p = views.marked(spark, sf_dir)
    a, b = (p.where(w).select("channel", "group_id").distinct() for w in ("known", "NOT known AND message_id % 3 = 0"))
    found = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.union(b)}
    out = None
    for kind, df in found.items():
        part = df.select(F.lit(kind).alias("kind"), "channel", "group_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH g AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN event_type || '!' END AS argument, CASE event_id % 3 WHEN 0 THEN 'u' || user_id WHEN 1 THEN '' END AS own FROM events),
    c AS (SELECT event_id, coalesce(nullif(argument, ''), nullif(own, '')) AS given FROM g)
    SELECT event_id, CASE WHEN given IS NULL THEN 'main' WHEN regexp_matches(given, '^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$') THEN given ELSE 'legacy' END AS group_id FROM c"""
)
def sup19_group_resolution(spark, sf_dir):
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    argument = F.when(i % 4 == 0, F.col("event_type")).when(i % 4 == 1, "").when(i % 4 == 2, F.concat("event_type", F.lit("!")))
    own = F.when(i % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).when(i % 3 == 1, "")
    return e.select("event_id", store.group_of(argument, own, "main").alias("group_id"))


@query(
    f"""WITH {views.EVENTS}, {views.CALLS}, k AS (SELECT 'calls' AS kind, group_id, at_s, 90 AS days, {views.START + 105 * 86400} AS now FROM calls UNION ALL SELECT 'night', group_id, at_s, 30, {views.START + 45 * 86400} FROM calls WHERE id % 2 = 0)
    SELECT kind, group_id, count(*) AS n, min(at_s) AS first_s FROM k WHERE at_s >= now - days * 86400 GROUP BY 1, 2"""
)
def snk14_retention_ledgers(spark, sf_dir):
    """Calls and night rows that stay, at times when half of them are too old."""
    c = views.calls(spark, sf_dir).withColumn("at", F.timestamp_seconds("at_s"))
    now = lambda day: F.timestamp_seconds(F.lit(views.START + day * 86400))
    kept = {"calls": store.retained(c, "at", fixed.RETENTION_DAYS["calls"], now(105)), "night": store.retained(c.where("id % 2 = 0"), "at", fixed.RETENTION_DAYS["night"], now(45))}
    both = kept["calls"].withColumn("kind", F.lit("calls")).unionByName(kept["night"].withColumn("kind", F.lit("night")))
    return both.groupBy("kind", "group_id").agg(F.count("*").alias("n"), F.min("at_s").alias("first_s"))


@query(
    f"""WITH s AS (SELECT conv_id, turn, {strip("CASE turn % 3 WHEN 0 THEN text || '。' || role || chr(10) || 'end' ELSE text END")} AS s FROM conversations),
    p AS (SELECT *, list_filter(list_transform(string_split(replace(s, chr(10), '。'), '。'), lambda x: {strip('x')}), lambda x: x <> '') AS parts FROM s)
    SELECT conv_id, turn, md5(array_to_string(CASE WHEN len(parts) >= 2 THEN parts ELSE list_filter([{strip('substr(s, 1, 72)')}, {strip('substr(s, 73, 72)')}, {strip('substr(s, 145, 72)')}], lambda x: x <> '') END, '|')) AS details_md5 FROM p"""
)
def strf21_details(spark, sf_dir):
    """Details of every turn: sentences, or pieces where there is only one."""
    c = views.table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("。"), "role", F.lit("\nend"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(F.array_join(cards.split_details(text), "|")).alias("details_md5"))


@query(f"WITH {views.EVENTS}, {LOCAL} SELECT event_id, mi >= 480 AS by_quiet, mi >= 30 AS by_shoulder, TRUE AS without FROM m")
def dt6_day_start(spark, sf_dir):
    """Whether an event's minute is past the day's start: that of the quiet window, of the shoulder one, or midnight."""
    minute = timewin.minute_of_day(F.col("l"))
    starts = {"by_quiet": timewin.day_start("00:00-08:00", "22:00-00:00"), "by_shoulder": timewin.day_start("", "22:00-00:30"), "without": timewin.day_start("", "")}
    return local_events(spark, sf_dir).select("event_id", *[(minute >= v).alias(k) for k, v in starts.items()])


@query(f"WITH {POSTS} SELECT message_id, md5('Channel: @' || channel || chr(10) || 'Message: #' || message_id || chr(10) || 'Published: ' || published_s || chr(10) || 'Text:' || chr(10) || text) AS prompt_md5 FROM posts")
def sup23_post_prompt(spark, sf_dir):
    p = views.posts(spark, sf_dir)
    return p.select("message_id", F.md5(prompts.post_prompt(F.col("channel"), F.col("message_id"), F.unix_seconds("published_at").cast("string"), F.col("text"))).alias("prompt_md5"))


@query(
    f"""WITH {POSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY published_s DESC, channel, message_id) AS rank FROM posts)
    SELECT group_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg('[' || rank || '] @' || channel || '#' || message_id || chr(10) || 'media: ' || CASE WHEN message_id % 3 > 0 THEN 'photo' ELSE '' END || chr(10) || 'photos: ' || message_id % 3 || chr(10)
      || CASE message_id % 3 WHEN 0 THEN '(none)' WHEN 1 THEN 'https://' || channel ELSE 'https://' || channel || chr(10) || 'https://b.example' END || chr(10) || CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || ' …[cut]' ELSE text END, chr(10) || chr(10) ORDER BY rank)) AS prompt_md5
    FROM r WHERE rank <= 20 GROUP BY 1"""
)
def sup24_photo_prompt(spark, sf_dir):
    i, own = F.col("message_id"), F.concat(F.lit(" https://"), "channel")
    urls = F.when(i % 3 == 1, F.array(own, F.lit(" "))).when(i % 3 == 2, F.array(own, F.lit("https://b.example ")))
    batch = ranking.batch(views.posts(spark, sf_dir).withColumn("urgent", F.lit(False))).withColumn("media_urls", urls).withColumn("media_type", F.when(i % 3 > 0, "photo"))
    return prompts.photo_prompts(batch).select("group_id", "n", F.md5("prompt").alias("prompt_md5"))


@query("SELECT event_id, TRUE AS poll_within, TRUE AS channel_within FROM events")
def mth5_poll_delays(spark, sf_dir):
    """Whether the drawn delays of every event are within their bounds."""
    e = views.table(spark, sf_dir, "events").withColumn("base", (F.col("user_id") % 50).cast("double"))
    d = e.withColumn("poll", mathfn.poll_delay(F.col("base"), 0.2, 3)).withColumn("pause", mathfn.channel_delay(seed=4))
    low, high = F.greatest(F.lit(1.0), F.col("base") * 0.8), F.greatest(F.lit(1.0), F.col("base") * 1.2)
    return d.select("event_id", F.col("poll").between(low - 1e-9, high + 1e-9).alias("poll_within"), F.col("pause").between(1.5, 3.5).alias("channel_within"))
