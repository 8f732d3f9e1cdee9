"""The digest pipeline: ingest, select, evaluate, gate and record, for all groups in one plan each.

The evaluator and the delivery are the only opaque points; they are injected, and an offline evaluator is
built in. The clock is an argument everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..functions import timewin
from ..operators import filters, nearjoin, ranking, store
from ..operators.cut import cut
from ..sources.config import Settings


def heuristic(text: Column, channel: Column, message_id: Column) -> Column:
    """A struct (score, is_news, is_spam, title, summary_bullets, key_takeaways, category) by keywords alone."""
    body = tx.stripped(F.coalesce(text, F.lit("")))
    low = F.lower(body)
    hits = F.filter(F.array(*[F.lit(k) for k in fixed.BREAKING_KEYWORDS]), lambda k: F.contains(low, k))
    found = F.size(hits) > 0
    sentence = tx.stripped(F.element_at(F.split(body, r"[。！？!?\n]"), 1))
    sentence = F.when(F.length(sentence) > 40, F.concat(F.substring(sentence, 1, 37), F.lit("..."))).otherwise(sentence)
    sentence = F.when(sentence == "", F.concat(F.lit(fixed.HEURISTIC["from"]), channel, F.lit(fixed.HEURISTIC["news"]))).otherwise(sentence)
    snippet = F.when(F.length(body) > 200, F.concat(F.substring(body, 1, 200), F.lit("..."))).otherwise(body)
    urgent_bullets = F.array(F.concat(F.lit(fixed.HEURISTIC["source"]), snippet), F.concat(F.lit(fixed.HEURISTIC["words"]), F.array_join(F.slice(hits, 1, 3), ", ")), F.lit(fixed.HEURISTIC["fallback"]))
    return F.struct(
        F.when(found, 7).otherwise(3).alias("score"),
        found.alias("is_news"),
        F.lit(False).alias("is_spam"),
        F.when(found, F.concat(F.lit(fixed.HEURISTIC["alert"]), sentence)).otherwise(F.concat(F.lit(fixed.HEURISTIC["plain"]), channel, F.lit("#"), message_id.cast("string"))).alias("title"),
        F.when(found, urgent_bullets).otherwise(F.array(F.lit("未匹配突发高优先级关键词，降级跳过告警"))).alias("summary_bullets"),
        F.array(F.when(found, "当前信息由规则引擎自动提取，请务必核验频道原文真实性。").otherwise("API服务不可用，经规则判定非紧急突发事件")).alias("key_takeaways"),
        F.when(found, fixed.URGENT_CATEGORY).otherwise(fixed.CHAT_CATEGORY).alias("category"),
    )


class Evaluator(Protocol):
    """From the batches of all groups (group_id, channel, message_id, text, rank), items with
    (group_id, channel, message_id, pos, score, title, summary, category)."""

    def evaluate(self, batch: DataFrame) -> DataFrame: ...


class KeywordEvaluator:
    """Offline: items of the posts that meet a breaking keyword, at most `most` a group."""

    def __init__(self, most: int = 5):
        self.most = most

    def evaluate(self, batch: DataFrame) -> DataFrame:
        e = batch.withColumn("e", heuristic(F.col("text"), F.col("channel"), F.col("message_id"))).where("e.is_news")
        items = e.select("group_id", "channel", "message_id", F.col("rank").alias("pos"), "e.score", "e.title", F.element_at("e.summary_bullets", 1).alias("summary"), "e.category")
        return ranking.capped(items, ["group_id"], [F.col("pos")], self.most).where("within_cap").drop("within_cap")


class EvaluationFailed(Exception):
    """No evaluator gave items for a batch."""


class FallbackEvaluator:
    """The first of several evaluators that answers: each one's items are computed before the next is asked."""

    def __init__(self, *evaluators: Evaluator):
        self.evaluators = list(dict.fromkeys(evaluators))

    def evaluate(self, batch: DataFrame) -> DataFrame:
        said = []
        for e in self.evaluators:
            try:
                return cut(e.evaluate(batch))
            except Exception as x:
                said.append(f"{type(e).__name__}: {x}".splitlines()[0])
        raise EvaluationFailed("; ".join(said))


ITEMS = "group_id string, channel string, message_id long, pos int, score int, title string, summary string, category string"

CLAIMS = "group_id string, fingerprint string, claimed long, summary string"
CALLS = "group_id string, started long"


@dataclass(frozen=True)
class Pass:
    """Results of one pass: what became of every pending post, the items to send in order, each group's gate, and the claims
    (CLAIMS; to be written before anything is sent) and calls (CALLS) that it adds. release() drops what it holds.

    failure: why the evaluator gave nothing. The batch's posts stay pending then; its calls count all the same."""

    outcomes: DataFrame
    items: DataFrame
    gates: DataFrame
    claims: DataFrame
    calls: DataFrame
    held: tuple[DataFrame, ...] = ()
    failure: str | None = None

    def counted(self) -> tuple[DataFrame, Observation]:
        """The outcomes, and counters of them that are there once they have been written: seen, of each state, of each
        reason a column `reason_<reason>`, and of posts that were evaluated. They cost no pass of their own."""
        reasons = [fixed.EXPIRED, fixed.DUPLICATE, fixed.COARSE, fixed.CRYPTO_REASON, fixed.TOPIC_REASON, fixed.DIGEST_FILTERED, fixed.NEAR_DUPLICATE]
        counters = Observation("pass")
        state, reason = F.col("state"), F.col("filter_reason")
        evaluated = (state == "selected") | reason.isin(fixed.DIGEST_FILTERED, fixed.NEAR_DUPLICATE)
        counts = [F.count(F.lit(1)).alias("seen"), F.count_if(F.coalesce(evaluated, F.lit(False))).alias("evaluated"), *[F.count_if(state == x).alias(x) for x in ("pending", "filtered", "selected")]]
        return self.outcomes.observe(counters, *counts, *[F.count_if(F.coalesce(reason == x, F.lit(False))).alias(f"reason_{x}") for x in reasons]), counters

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


class Pipeline:
    def __init__(self, settings: Settings, evaluator: Evaluator | None = None, policy: dict | None = None):
        self.settings, self.evaluator, self.policy = settings, evaluator or KeywordEvaluator(), policy

    def ingest(self, posts: DataFrame, stored: DataFrame) -> DataFrame:
        """Rows to append to the table of posts."""
        return store.insert_if_absent(posts, stored, [F.col("scraped_at"), F.col("text")])

    def _each(self, value: Callable[[Callable[[str], object]], Column]) -> Column:
        """value(setting) of a row's group: by the group's own settings where it has any."""
        s = self.settings
        out = value(lambda name: getattr(s, name))
        for g in s.groups:
            if g.overrides:
                out = F.when(F.col("group_id") == g.id, value(lambda name, g=g: s.of(g, name))).otherwise(out)
        return out

    def _knob(self, mode: Column, place: int, own: str | None = None) -> Column:
        """A threshold of fixed.KNOBS by mode; in day mode the setting `own` if one is named."""
        day = F.lit(fixed.KNOBS[fixed.DAY][place]) if own is None else self._each(lambda get: F.lit(get(own)))
        return F.when(mode == fixed.QUIET, fixed.KNOBS[fixed.QUIET][place]).when(mode == fixed.SHOULDER, fixed.KNOBS[fixed.SHOULDER][place]).otherwise(day)

    def _in_window(self, value: Column, now: Column) -> Column:
        """Whether an instant is in the quiet window that holds now, or was the latest, and not ahead of now."""

        def inside(get) -> Column:
            local, at = timewin.local_time(now, get("timezone")), timewin.local_time(value, get("timezone"))
            start, end = timewin.quiet_bounds(local, get("quiet_hours"))
            return (at >= start) & (at < end)

        return timewin.before(value, now) & self._each(inside)

    def process_pending(self, posts: DataFrame, claims: DataFrame, now: Column, calls: DataFrame | None = None, sent: DataFrame | None = None) -> Pass:
        """Decide every pending post. posts: keyed table with evaluated_at; claims: group_id, fingerprint, claimed, and, for
        near-duplicates, summary; calls: (group_id, started), none by default; sent: (group_id, n) cards sent in the running quiet
        window. Times are seconds.

        Mode, windows and thresholds are those of now and of each group's settings. The queue's limit comes before the
        filters; posts beyond it, in closed gates, or beyond the batch stay pending."""
        spark = posts.sparkSession
        limit = self._each(lambda get: F.lit(ranking.load_limit(get("batch"), get("pending_multiplier"))))
        mode = self._each(lambda get: timewin.mode(timewin.local_time(now, get("timezone")), get("quiet_hours"), get("shoulder_hours")))
        queue = ranking.pending_by_group(posts, limit).drop("position").withColumn("fingerprint", tx.fingerprint("text")).withColumn("mode", mode)
        news_age = self._each(lambda get: F.lit(get("news_max_age_seconds")))
        age = self._knob(F.col("mode"), 5, "news_max_age_seconds")
        ok = filters.eligible(F.col("published_at"), F.col("scraped_at"), age, now, F.col("mode") == fixed.QUIET, self._in_window(F.col("published_at"), now), F.lit(False))
        recent = store.seen(queue, claims, F.unix_seconds(now) - fixed.WINDOW_SECONDS).select(*store.KEY, F.lit(True).alias("claimed_before")).distinct()
        marked = ranking.newest_by_fingerprint(queue.withColumn("ok", ok), ("ok", "group_id", "fingerprint")).join(recent, list(store.KEY), "left")
        reason = (
            F.when(~F.col("ok"), fixed.EXPIRED)
            .when(F.col("duplicate") | F.coalesce("claimed_before", F.lit(False)), fixed.DUPLICATE)
            .otherwise(filters.bucket(F.col("text"), F.col("group_id"), self.policy))
        )
        routed = marked.select(*queue.columns, reason.alias("filter_reason")).persist()
        candidates = routed.where("filter_reason IS NULL").withColumn("urgent", filters.is_urgent(F.col("text")) & timewin.fresh(F.col("published_at"), news_age, now))
        gates = self.admitted(candidates, now, calls if calls is not None else spark.createDataFrame([], CALLS)).persist()
        opened = candidates.join(gates.where("admitted").select("group_id"), "group_id", "left_semi")
        batch = ranking.batch(opened, self._each(lambda get: F.lit(get("batch")))).persist()
        # two phases: the evaluator's answer is there, or its failure known, before any post's outcome is decided
        try:
            answered, failure = cut(self.evaluator.evaluate(batch)), None
        except Exception as e:
            answered, failure = spark.createDataFrame([], ITEMS), f"{type(e).__name__}: {e}".splitlines()[0]
        items = self.vetted(ranking.first_items(answered, batch), batch, claims, now).persist()
        chosen = items.where("item_reason IS NULL OR item_reason = 'near_duplicate'")
        outcomes = ranking.outcome(routed.join(batch.select(*store.KEY, F.lit(True).alias("in_batch")), list(store.KEY), "left"), chosen)
        outcomes = outcomes.join(items.where("item_reason IS NOT NULL").select(*store.KEY, "item_reason"), list(store.KEY), "left")
        waits = (F.col("in_batch").isNull() | F.lit(failure is not None)) & (F.col("filter_reason") == fixed.DIGEST_FILTERED)
        outcomes = outcomes.withColumn("filter_reason", F.when(~F.coalesce(waits, F.lit(False)), F.coalesce("item_reason", "filter_reason")))
        state = F.when(F.col("filter_reason").isNotNull(), "filtered").when(F.col("in_batch") & F.lit(failure is None), "selected").otherwise("pending")
        sending = self.to_send(items.where("item_reason IS NULL"), now, sent)
        new_claims = sending.select("group_id", "fingerprint", F.unix_seconds(now).alias("claimed"), F.substring(tx.blob(F.col("title"), F.col("summary")), 1, fixed.CLAIM_SUMMARY_MAX).alias("summary"))
        new_calls = gates.where("admitted").select("group_id", F.unix_seconds(now).alias("started"))
        return Pass(outcomes.select(*store.KEY, "filter_reason", state.alias("state")), sending.orderBy("published_at", "pos"), gates, new_claims, new_calls, (routed, gates, batch, items), failure)

    def admitted(self, candidates: DataFrame, now: Column, calls: DataFrame) -> DataFrame:
        """Each group's gate (see ranking.gate), and whether the call budgets admit it: its cooldown, its calls of the UTC day, and
        those of all groups, which go by group_id. At night only urgent candidates or the long wait open a gate."""
        m = F.first("mode").alias("mode")
        gates = candidates.groupBy("group_id").agg(m, F.count("*").alias("n"), F.greatest(F.lit(0), F.unix_seconds(now) - F.min(F.unix_seconds("scraped_at"))).alias("oldest"), F.bool_or("urgent").alias("any_urgent"))
        mode, quiet = F.col("mode"), F.col("mode") == fixed.QUIET
        long_wait = F.when(quiet, F.col("oldest") >= self._knob(mode, 2)).otherwise((F.col("n") >= self._knob(mode, 0)) | (F.col("oldest") >= self._knob(mode, 1)))
        gates = gates.withColumn("open", F.col("any_urgent") | long_wait)
        today = F.unix_seconds(now) - F.unix_seconds(now) % 86400
        used = calls.groupBy("group_id").agg(F.max("started").alias("last"), F.count_if(F.col("started") >= today).alias("today"))
        total = calls.where(F.col("started") >= today).count()
        pause = F.when(quiet & ~F.col("any_urgent"), self._knob(mode, 2)).otherwise(self._knob(F.when(quiet, fixed.DAY).otherwise(mode), 2, "min_call_interval_seconds"))
        cool = F.col("last").isNull() | (F.unix_seconds(now) - F.col("last") >= pause)
        within = F.coalesce("today", F.lit(0)) < self._each(lambda get: F.lit(get("daily_calls")))
        ready = gates.join(used, "group_id", "left").withColumn("ready", F.col("open") & cool & within)
        place = F.row_number().over(Window.partitionBy("ready").orderBy("group_id"))  # as many rows as groups
        return ready.withColumn("admitted", F.col("ready") & (place + total <= self.settings.daily_calls)).select("group_id", "mode", "n", "oldest", "any_urgent", "open", "admitted")

    def vetted(self, items: DataFrame, batch: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
        """Items with their post's columns and item_reason: subjects that the evaluator should not have chosen, and near-duplicates
        of what was claimed in the last day, unless they are material updates; null for others."""
        post = batch.select(*store.KEY, "published_at", "fingerprint", "mode")
        full = items.join(post, list(store.KEY))
        for name, kind in (("event_at", "timestamp"), ("summary_bullets", "array<string>"), ("is_update", "boolean"), ("update_reason", "string"), ("actionable_insight", "string")):
            if name not in full.columns:
                full = full.withColumn(name, F.col("published_at") if name == "event_at" else F.lit(None).cast(kind))
        full = full.withColumn("blob", tx.blob(F.col("title"), F.col("summary"))).withColumn("reason", F.coalesce("update_reason", F.lit("")))
        if "summary" in claims.columns:
            recents = ranking.recent_summaries(claims, F.unix_seconds(now) - fixed.WINDOW_SECONDS).select("group_id", "summary")
            full = nearjoin.against_recent(full, recents)
        else:
            full = full.withColumn("near_duplicate", F.lit(False))
        subject = filters.subject_reason(F.col("category"), F.col("title"), F.col("summary"), F.col("summary_bullets"), F.col("actionable_insight"), F.col("group_id"), self.policy)
        return full.withColumn("item_reason", F.coalesce(subject, F.when(F.col("near_duplicate"), fixed.NEAR_DUPLICATE))).drop("blob", "reason", "near_duplicate")

    def to_send(self, items: DataFrame, now: Column, sent: DataFrame | None) -> DataFrame:
        """Items that no gate stops, in order: post and event are fresh, the score is high enough for the mode, and the quiet
        window's cap isn't reached."""
        news_age, mode = self._each(lambda get: F.lit(get("news_max_age_seconds"))), F.col("mode")
        rows = items.join(sent, "group_id", "left").withColumnRenamed("n", "sent_before") if sent is not None else items.withColumn("sent_before", F.lit(0))
        gates = lambda cap, before: filters.send_decision(
            mode, mode, timewin.fresh(F.col("published_at"), news_age, now), timewin.fresh(F.col("event_at"), news_age, now), F.col("score"), self._knob(mode, 3, "min_score"), before, cap
        )
        passed = rows.where(gates(F.lit(None).cast("int"), F.lit(0)) == "send")
        order = F.row_number().over(Window.partitionBy("group_id").orderBy("published_at", "pos"))
        cap = F.when(mode == fixed.QUIET, self._each(lambda get: F.lit(get("quiet_card_cap"))))
        return passed.withColumn("decision", gates(cap, F.coalesce("sent_before", F.lit(0)) + order - 1)).where("decision = 'send'").drop("decision", "sent_before")

    def run_once(self, spark: SparkSession, pages: DataFrame, stored: DataFrame, claims: DataFrame, now: Column, ingest_only: bool = False, calls: DataFrame | None = None) -> tuple[DataFrame, Pass | None]:
        """New posts of pages (group_id, channel, html), and the pass over stored and new ones."""
        from ..sources.pages import posts as parsed

        groups = pages.select("group_id", "channel").distinct()
        fresh = parsed(pages).join(groups, "channel").withColumns({"scraped_at": now, "evaluated_at": F.lit(None).cast("timestamp")})
        new = self.ingest(fresh.select(*[c for c in stored.columns if c in fresh.columns]), stored)
        return new, None if ingest_only else self.process_pending(stored.unionByName(new, allowMissingColumns=True), claims, now, calls)
