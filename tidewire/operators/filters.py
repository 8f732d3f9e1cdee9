"""Predicates and ordered routing of posts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..functions import timewin


def _any(*patterns: str) -> str:
    return tx.pattern(*patterns)


def is_spam(text: Column) -> Column:
    return tx.any_match(text, *fixed.SPAM)


def is_short(text: Column) -> Column:
    return F.length(tx.stripped(text)) < fixed.SPAM_MIN_LENGTH


def is_crypto(text: Column) -> Column:
    return tx.any_match(text, *fixed.CRYPTO)


def is_urgent(text: Column) -> Column:
    return tx.any_match(text, fixed.URGENT)


def is_unsafe_photo_text(text: Column) -> Column:
    return tx.any_match(text, *fixed.VICE, *fixed.POLITICAL, fixed.NEWS_LIKE)


def is_news_like(category: Column, *texts: Column) -> Column:
    name = tx.stripped(F.coalesce(category, F.lit("")))
    return name.isin(*fixed.NEWS_LIKE_CATEGORIES) | F.concat_ws(" ", name, *texts).rlike(_any(fixed.NEWS_LIKE))


def is_photo_post(has_media: Column, media_type: Column, urls: Column) -> Column:
    kind = F.lower(tx.stripped(F.coalesce(media_type, F.lit(""))))
    return F.coalesce(has_media, F.lit(False)) & kind.isin(*fixed.PHOTO_TYPES) & (F.size(tx.photo_urls(urls)) > 0)


def topic_matches(text: Column, group: Column, policy: Mapping[str, Mapping]) -> Column:
    """Whether a post's text meets its group's topic policy.

    policy: 'default' and groups, each {'enabled': bool, 'patterns': [...]}; a group's own block wins
    even if it is disabled. Patterns that don't compile are left out."""

    def block(spec: Mapping | None) -> Column:
        good = [j for p in (spec or {}).get("patterns", ()) if (j := _java(p)) is not None]
        if not spec or not spec.get("enabled", True) or not good:
            return F.lit(False)
        return text.rlike(_any(*good))

    out = block(policy.get("default"))
    for name, spec in policy.items():
        if name != "default":
            out = F.when(group == name, block(spec)).otherwise(out)
    return out


def _java(p: object) -> str | None:
    """A pattern of Python's syntax as Java's, or None if either doesn't know it. Differences are those of named groups
    ((?P<x>…), (?P=x)), of \\Z and of inline comments; the JVM itself says whether the rest compiles."""
    from pyspark import SparkContext

    try:
        re.compile(p, re.I)
    except (re.error, TypeError):
        return None
    out = re.sub(r"\(\?#[^)]*\)", "", p)
    names: list[str] = []

    def name(m: re.Match) -> str:
        names.append(m[1])
        return f"(?<g{len(names) - 1}>"

    out = re.sub(r"\(\?P<(\w+)>", name, out)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<g{names.index(m[1])}>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(_any(out))
    except Exception as e:  # py4j's error of a PatternSyntaxException
        if "PatternSyntaxException" not in str(e):
            raise
        return None
    return out


def bucket(text: Column, group: Column | None = None, policy: Mapping[str, Mapping] | None = None) -> Column:
    """coarse_filter, crypto_filter, topic_filter or null (kept); the first that applies."""
    t = F.coalesce(text, F.lit(""))
    out = F.when(is_short(t) | is_spam(t), fixed.COARSE).when(is_crypto(t), fixed.CRYPTO_REASON)
    return out.when(topic_matches(t, group, policy), fixed.TOPIC_REASON) if policy and group is not None else out


def photo_reason(has_media: Column, media_type: Column, urls: Column, text: Column) -> Column:
    """Why a photo post isn't taken in, or null; there is no minimum length."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(~is_photo_post(has_media, media_type, urls), fixed.NOT_PHOTO)
        .when(is_unsafe_photo_text(t), fixed.PHOTO_UNSAFE)
        .when(is_news_like(F.lit(""), t), fixed.PHOTO_NEWS)
        .when(is_spam(t), fixed.COARSE)
        .when(is_crypto(t), fixed.CRYPTO_REASON)
    )


def photo_block_reason(category: Column, title: Column, summary: Column, bullets: Column, urls: Column) -> Column:
    """Why a photo item isn't sent, or null."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, summary)] + [F.array_join(F.coalesce(bullets, F.array().cast("array<string>")), " ")]
    whole = F.concat_ws(" ", F.coalesce(category, F.lit("")), *parts)
    return F.when(is_unsafe_photo_text(whole), fixed.PHOTO_UNSAFE).when(is_news_like(category, *parts), fixed.PHOTO_NEWS).when(F.size(tx.photo_urls(urls)) == 0, fixed.NO_URLS)


def eligible(published: Column, scraped: Column, max_age: Column, now: Column, quiet: Column, in_window: Column, photo: Column) -> Column:
    """Fresh; or in a quiet hour, published inside the window; photo posts go by the time they were read."""
    return F.when(photo, timewin.fresh(scraped, max_age, now)).otherwise(timewin.fresh(published, max_age, now) | (quiet & in_window))


def attributed(source: Column, text: Column) -> Column:
    """Whether a trusted source is named in the text as a whole word."""
    name = F.lower(tx.stripped(source))
    out = F.lit(False)
    for s in fixed.TRUSTED_SOURCES:
        out = out | ((name == s) & F.lower(text).rlike(rf"(?U)(?<!\w){re.escape(s)}(?!\w)"))
    return out


def send_decision(mode_then: Column, mode_now: Column, post_fresh: Column, event_fresh: Column, score: Column, least: Column, sent_in_window: Column, cap: Column) -> Column:
    """The first gate that stops an item, or 'send'."""
    return (
        F.when(mode_then != mode_now, "mode_changed")
        .when(~post_fresh, fixed.EXPIRED)
        .when(~event_fresh, fixed.EVENT_TIME)
        .when(F.coalesce(score, F.lit(0)) < least, "below_threshold")
        .when(cap.isNotNull() & (sent_in_window >= cap), "card_cap")
        .otherwise("send")
    )


def subject_reason(category: Column, title: Column, summary: Column, bullets: Column, insight: Column, group: Column | None = None, policy: Mapping[str, Mapping] | None = None) -> Column:
    """Why an evaluated item is dropped for its subject, or null: crypto_filter by category or text, then topic_filter."""
    texts = [F.coalesce(c, F.lit("")) for c in (category, title, summary)]
    blob = F.concat_ws(" ", *texts, F.array_join(F.coalesce(bullets, F.array().cast("array<string>")), " "), F.coalesce(insight, F.lit("")))
    out = F.when((tx.stripped(texts[0]) == fixed.CRYPTO_CATEGORY) | is_crypto(blob), fixed.CRYPTO_REASON)
    return out.when(topic_matches(blob, group, policy), fixed.TOPIC_REASON) if policy and group is not None else out


def tally(posts: DataFrame, reason: Column) -> DataFrame:
    """reason (kept for null) and how many posts it has."""
    return posts.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
