"""Queues, batches, first-of and running counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..functions import timewin


def pending(posts: DataFrame, limit: int, group: str | None = None) -> DataFrame:
    """Posts without an evaluation, longest waiting first; nothing for a limit of 0 or less.

    The limit applies before any filter."""
    rows = posts.where("evaluated_at IS NULL")
    if group is not None:
        rows = rows.where(F.col("group_id") == group)
    return rows.orderBy("scraped_at", "message_id", "group_id", "channel").limit(max(limit, 0))


def pending_by_group(posts: DataFrame, limit: int | Column) -> DataFrame:
    """The queue of every group at once, with its position."""
    w = Window.partitionBy("group_id").orderBy("scraped_at", "message_id", "channel")
    return posts.where("evaluated_at IS NULL").withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def load_limit(batch: int = fixed.BATCH, multiplier: int = fixed.PENDING_MULTIPLIER, explicit: int | None = None) -> int:
    return explicit if explicit is not None else max(batch, batch * multiplier)


def newest_by_fingerprint(posts: DataFrame, key: Sequence[str] = ("group_id", "fingerprint")) -> DataFrame:
    """duplicate: whether a newer post has the same fingerprint; ties go by channel and id."""
    w = Window.partitionBy(*key).orderBy(F.desc("published_at"), "channel", "message_id")
    return posts.withColumn("duplicate", F.row_number().over(w) > 1)


def batch(posts: DataFrame, size: int | Column = fixed.BATCH) -> DataFrame:
    """The next batch of every group: urgent first, then newest; rank from 1."""
    w = Window.partitionBy("group_id").orderBy(F.desc("urgent"), F.desc("published_at"), "channel", "message_id")
    return posts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def item_score(score: Column, rank: Column) -> Column:
    """A score between 1 and 10; by default 11 less the rank."""
    return F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(score, F.lit(11) - rank)))


def capped(rows: DataFrame, key: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """within_cap: whether a row is among the first `cap` of its key."""
    return rows.withColumn("within_cap", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) <= cap)


def before(value: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """The largest value among earlier rows: a backward lookup."""
    return F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def flushes(modes: DataFrame) -> DataFrame:
    """From (group_id, at, day, mode): the first change from another mode to day on each date."""
    w = Window.partitionBy("group_id").orderBy("at")
    changes = modes.withColumn("before", F.lag("mode").over(w)).where((F.col("mode") == fixed.DAY) & (F.col("before") != fixed.DAY))
    return changes.groupBy("group_id", "day").agg(F.min("at").alias("at"))


def newest_claims(claims: DataFrame, cutoff: Column, most: int) -> DataFrame:
    """The newest claims of each group since cutoff, at most `most`, with their place n."""
    newest = Window.partitionBy("group_id").orderBy(F.desc("claimed"), "fingerprint")
    return claims.where(F.col("claimed") >= cutoff).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)


def recent_summaries(claims: DataFrame, cutoff: Column, most: int = fixed.RECENT_MAX) -> DataFrame:
    """Distinct stripped summaries of each group, newest first, at most `most`, out of the newest 2 * most claims; claims
    without a summary count among these."""
    rows = newest_claims(claims, cutoff, 2 * most).withColumn("summary", tx.stripped(F.coalesce("summary", F.lit("")))).where("summary <> ''")
    once = rows.groupBy("group_id", "summary").agg(F.min("n").alias("n"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy("group_id").orderBy("n"))).where(F.col("position") <= most).drop("n")


def merged_overnight(archived: DataFrame, waiting: DataFrame) -> DataFrame:
    """Archived and waiting posts of the night, an archived one's score first; waiting ones count 7."""
    both = archived.withColumn("_from", F.lit(0)).unionByName(waiting.withColumn("score", F.lit(7)).withColumn("_from", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("group_id", "channel", "message_id").orderBy("_from")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")


def first_items(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items (with pos) of known candidates, the first for each post."""
    key = ["group_id", "channel", "message_id"]
    known = items.join(candidates.select(*key).distinct(), key, "left_semi")
    return known.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where("_n = 1").drop("_n")


def outcome(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates with their item's score, or the reason digest_filtered where they have none."""
    key = ["group_id", "channel", "message_id"]
    j = candidates.join(items.select(*key, F.col("score").alias("item_score")), key, "left")
    reason = F.when(F.col("item_score").isNull(), F.coalesce(F.col("filter_reason"), F.lit(fixed.DIGEST_FILTERED))).otherwise(F.col("filter_reason"))
    return j.withColumn("filter_reason", reason)


def gate(candidates: DataFrame, now: Column, least: int, max_wait: int) -> DataFrame:
    """Of each group: count, oldest age, whether one is urgent, and whether the batch goes out."""
    out = candidates.groupBy("group_id").agg(
        F.count("*").alias("n"), F.greatest(F.lit(0), F.unix_seconds(now) - F.min(F.unix_seconds("scraped_at"))).alias("oldest"), F.bool_or("urgent").alias("any_urgent")
    )
    return out.withColumn("open", F.col("any_urgent") | (F.col("n") >= least) | (F.col("oldest") >= max_wait))


def night_recap(items: DataFrame, quiet: str = "00:00-08:00", tz: str = "Asia/Shanghai", most: int = fixed.BATCH) -> DataFrame:
    """The recap of each night: (group_id, day, rank, channel, message_id, score).

    items: group_id, channel, message_id, at (an instant), score, fingerprint. A night is the quiet window, and has the date of its
    end. Of a post's items in a night the latest counts (of one time the highest score); of one fingerprint the best by
    score, then time, then channel and post; of these the first `most`."""
    local = timewin.local_time(F.col("at"), tz)
    end = timewin.quiet_bounds(local, quiet)[1]
    inside = timewin.Span.parse(quiet).holds(timewin.minute_of_day(local))
    night = items.where(inside).withColumn("day", F.date_format(F.to_date(end), "yyyy-MM-dd"))
    first = lambda df, by, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
    last = first(night, ["group_id", "day", "channel", "message_id"], [F.desc("at"), F.desc("score"), F.desc("fingerprint")])
    best = [F.desc("score"), F.desc("at"), F.col("channel"), F.col("message_id")]
    once = first(last, ["group_id", "day", "fingerprint"], best)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("group_id", "day").orderBy(*best)))
    return ranked.where(F.col("rank") <= most).select("group_id", "day", "rank", "channel", "message_id", "score")
