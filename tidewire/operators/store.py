"""Keyed tables: insert-if-absent, updates, state folds and retention.

Tables are snapshots; every function returns the new snapshot (or the rows to append) as a plan, and the
caller writes it. Keys always hold the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("group_id", "channel", "message_id")


def channel_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "^@+", "")


def safe_group(c: Column, default: str = "legacy") -> Column:
    return F.when(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}\z"), c).otherwise(default)


def group_of(argument: Column, own: Column, default: str = "legacy") -> Column:
    """The group that a row belongs to: the one asked for, else its own, else the default. A name that isn't safe becomes
    the general one."""
    given = F.coalesce(F.when(argument != "", argument), F.when(own != "", own))
    return F.when(given.isNull(), default).otherwise(safe_group(given))


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unseen(new: DataFrame, stored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows whose key isn't stored; rows that repeat within `new` all stay."""
    return new.join(stored.select(*key).distinct(), list(key), "left_anti")


def insert_if_absent(new: DataFrame, stored: DataFrame, order: Sequence[Column], key: Sequence[str] = KEY) -> DataFrame:
    """The rows to append: unseen ones, and of rows with one key the first."""
    return first_by(unseen(new, stored, key), key, order)


def seen(rows: DataFrame, claims: DataFrame, cutoff: Column, key: Sequence[str] = ("group_id", "fingerprint")) -> DataFrame:
    """Rows whose fingerprint has a claim at or after the cutoff."""
    return rows.join(claims.where(F.col("claimed") >= cutoff).select(*key).distinct(), list(key), "left_semi")


def apply_updates(stored: DataFrame, updates: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """stored with the updates' columns written over by key; alert_sent is only ever raised.

    updates holds one row for each key."""
    names = [c for c in updates.columns if c not in key]
    u = updates.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_u_{c}") for c in names])
    j = stored.join(u, list(key), "left")
    value = {c: F.when(F.col("_hit"), F.greatest(F.col(c), F.col("_u_alert_sent")) if c == "alert_sent" else F.col(f"_u_{c}")).otherwise(F.col(c)) for c in names}
    return j.select(*[value[c].alias(c) if c in value else F.col(c) for c in stored.columns])


def record_usage(calls: DataFrame, usage: DataFrame, key: Sequence[str] = ("group_id", "started")) -> DataFrame:
    """calls with the tokens that usage (key, tokens) tells; a call without usage keeps its own. Null is unknown, not 0, and of
    several rows for a call the largest counts."""
    u = usage.groupBy(*key).agg(F.max("tokens").alias("_tokens"))
    return calls.join(u, list(key), "left").select(*[F.coalesce("_tokens", "tokens").alias("tokens") if c == "tokens" else F.col(c) for c in calls.columns])


def schedule_rows(groups: DataFrame, stored: DataFrame) -> DataFrame:
    """A schedule row for each of groups (group_id): the stored one, or a new one with nothing sent yet."""
    new = groups.select("group_id").distinct().join(stored, "group_id", "left")
    return new.select(*[F.coalesce(c, F.lit(0)).alias(c) if c == "quiet_cards_sent" else F.col(c) for c in stored.columns])


def mark_sent(stored: DataFrame, sent: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """alert_sent 1 with its time; a new score or summary only where one is given."""
    u = sent.select(*key, F.lit(True).alias("_hit"), F.col("at").alias("_at"), F.col("score").alias("_score"), F.col("summary").alias("_summary"))
    j = stored.join(u, list(key), "left")
    value = {"alert_sent": F.when(F.col("_hit"), 1).otherwise(F.col("alert_sent")), "alert_sent_at": F.coalesce("_at", "alert_sent_at"), "score": F.coalesce("_score", "score"), "summary": F.coalesce("_summary", "summary")}
    return j.select(*[value[c].alias(c) if c in value else F.col(c) for c in stored.columns])


def failures(attempts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """From attempts (key, at, permanent, error): retry_count, alert_sent (-1 if the last one was permanent) and the last error.

    Of attempts at one time a permanent one is the last, then the one whose error sorts last."""
    last = F.max(F.struct("at", "permanent", F.coalesce("error", F.lit("")).alias("order"), "error"))
    return attempts.groupBy(*key).agg(F.count("*").alias("retry_count"), last.alias("x")).select(
        *key, "retry_count", F.when(F.col("x.permanent"), -1).otherwise(0).alias("alert_sent"), F.col("x.error").alias("alert_error")
    )


def channel_state(polls: DataFrame, key: Sequence[str] = ("group_id", "channel")) -> DataFrame:
    """Fold of polls (key, at, ord, success, message_id, seen, error) to one state row for each key.

    Aggregates by key before anything else moves: the error streak is the number of polls after the last
    success, found by a join of per-key maxima."""
    last_ok = polls.where("success").groupBy(*key).agg(F.max(F.struct("at", "ord")).alias("ok"))
    base = polls.groupBy(*key).agg(
        F.greatest(F.max("message_id"), F.lit(0)).alias("last_message_id"),
        F.max("at").alias("last_polled_at"),
        F.max(F.when(F.col("success"), F.col("at"))).alias("last_success_at"),
        F.sum("seen").alias("total_messages_seen"),
        F.max_by("error", F.struct("at", "ord")).alias("last_error"),
    )
    after = polls.join(last_ok, list(key), "left").where("NOT success AND (ok IS NULL OR struct(at, ord) > ok)").groupBy(*key).agg(F.count("*").alias("consecutive_errors"))
    return base.join(after, list(key), "left").withColumn("consecutive_errors", F.coalesce("consecutive_errors", F.lit(0)))


def heartbeats(log: DataFrame) -> DataFrame:
    """Latest beat by name."""
    return log.groupBy("name").agg(F.max("updated").alias("updated"))


def unhealthy(beats: DataFrame, now: Column, max_age: Column) -> DataFrame:
    """name and healthy; a beat older than max_age seconds isn't."""
    return beats.select("name", ((F.unix_seconds(now) - F.unix_seconds("updated")) <= max_age).alias("healthy"))


def retained(df: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    """Rows not older than `days`; rows without a time always stay."""
    return df.where(F.col(time).isNull() | (F.unix_seconds(time) >= F.unix_seconds(now) - days * 86400))


def night_archive(archive: DataFrame, new: DataFrame, today: Column, days: int = 3) -> DataFrame:
    """The archive (key, day, and other columns) with new rows written over old ones of the same key and day; days
    more than `days` before today are dropped."""
    both = archive.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both, [*KEY, "day"], [F.desc("_new")]).drop("_new").where(F.col("day") >= F.date_sub(today, days))


def migrated(df: DataFrame, key: Sequence[str], order: Sequence[Column], default: str = "legacy") -> DataFrame:
    """A table brought to the keyed form: a group column (default where absent or unsafe), one row for each key."""
    if "group_id" not in df.columns:
        df = df.withColumn("group_id", F.lit(default))
    return first_by(df.withColumn("group_id", safe_group(F.col("group_id"), default)), key, order)


def mark_filtered(posts: DataFrame, reason: Column | str, summary: Column) -> DataFrame:
    """Evaluation columns of posts that a filter took out."""
    r = F.lit(reason) if isinstance(reason, str) else reason
    return posts.withColumns({"score": F.lit(1), "is_filtered": F.lit(True), "filter_reason": r, "summary": F.concat(F.lit("[filtered] "), F.coalesce(summary, F.lit("")))})


def with_settings(rows: DataFrame, groups: DataFrame, defaults: dict) -> DataFrame:
    """rows with each setting of their group, or its default; the group table has a row for each group."""
    g = groups.select("group_id", *[F.col(k).alias(f"_g_{k}") for k in defaults if k in groups.columns])
    j = rows.join(g, "group_id", "left")
    return j.select(*rows.columns, *[(F.coalesce(F.col(f"_g_{k}"), F.lit(v)) if k in groups.columns else F.lit(v)).alias(k) for k, v in defaults.items()])


def exclusive_channels(groups: DataFrame) -> DataFrame:
    """Channels that more than one group lists, disabled groups included."""
    return groups.select("group_id", F.explode("channels").alias("channel")).select("group_id", channel_name(F.col("channel")).alias("channel")).distinct().groupBy("channel").agg(F.count("*").alias("n")).where("n > 1")
