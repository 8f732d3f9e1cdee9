"""Card texts and card JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .bind import let
from .text import stripped

LONG_CHARS, LONG_LINES, DETAILS, DETAIL_CHARS = 80, 2, 3, 72
MARKS = {"利多": "🟢 利多", "利空": "🔴 利空", "中性": "⚪ 中性", "不确定": "🟡 不确定"}


def _score(score: Column) -> Column:
    return F.coalesce(score.try_cast("int"), F.lit(1))


def color(score: Column) -> Column:
    s = _score(score)
    return F.when(s >= 9, "red").when(s >= 7, "orange").when(s >= 5, "blue").otherwise("grey")


def icon(score: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.ICONS.items() for x in kv])
    return F.element_at(table, color(score))


def flames(score: Column) -> Column:
    return F.repeat(F.lit("🔥"), F.least(F.lit(5), F.greatest(F.lit(1), F.floor((score + 1) / 2).cast("int"))))


def shows_impact(score: Column, category: Column, flag: Column) -> Column:
    """Whether the investment block is shown: flagged, score 9 or more, one of three categories."""
    number = score.try_cast("int")
    return F.coalesce(flag & (number >= fixed.IMPACT_MIN_SCORE) & stripped(category).isin(*fixed.IMPACT_CATEGORIES), F.lit(False))


def bias(value: Column) -> Column:
    """A bias with its mark; anything unknown is the last one."""
    v = stripped(F.coalesce(value, F.lit("")))
    out = F.lit(MARKS["不确定"])
    for name, shown in MARKS.items():
        out = F.when(v == name, shown).otherwise(out)
    return out


def is_long(summary: Column) -> Column:
    """More than 80 characters or more than two lines."""
    s = stripped(F.coalesce(summary, F.lit("")))
    return (F.length(s) > LONG_CHARS) | (F.size(F.split(s, "\n")) > LONG_LINES)


def polished(text: Column) -> Column:
    """Without list marks and ellipses, closed by a full stop; empty stays empty."""
    s = F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), r"^[•\-* ]+", "")
    s = F.trim(F.regexp_replace(s, r"[.…⋯． ]+$", ""))
    return let(s, lambda x: F.when(x == "", "").when(x.rlike("[。！？；]$"), x).otherwise(F.concat(x, F.lit("。"))))


def shortened(summary: Column, cap: int = LONG_CHARS) -> Column:
    """The first sentence, cut at a clause mark where it exceeds cap."""
    first = stripped(F.substring_index(polished(summary), "\n", 1))
    return let(first, lambda x: let(_sentence(x), lambda y: _cut(y, cap)))


def _sentence(first: Column) -> Column:
    sentence = first
    for mark in ("？", "！", "。"):
        head = stripped(F.substring_index(first, mark, 1))
        sentence = F.when(first.contains(mark) & (head != ""), F.concat(head, F.lit(mark))).otherwise(sentence)
    return sentence


def _cut(sentence: Column, cap: int) -> Column:
    window = F.substring(sentence, 1, cap)
    cut = window
    for mark in (" ", "；", "、", "，"):
        at = F.length(window) - F.instr(F.reverse(window), mark)  # characters before the last mark
        cut = F.when(window.contains(mark) & (at >= max(20, cap // 3)), F.substring(window, F.lit(1), at)).otherwise(cut)
    return polished(F.when(F.length(sentence) <= cap, sentence).otherwise(cut))


def detail_lines(details: Column) -> Column:
    """Up to three polished details as a list."""
    lines = F.transform(F.transform(F.slice(details, 1, DETAILS), polished), lambda d: F.when(F.length(d) > DETAIL_CHARS, shortened(d, DETAIL_CHARS)).otherwise(d))
    return F.array_join(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")


def split_details(summary: Column) -> Column:
    """Sentences of a summary, or pieces of 72 characters where there is only one."""
    text = stripped(F.coalesce(summary, F.lit("")))
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, "\n", "。"), "。"), stripped), lambda p: p != "")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(DETAILS - 1)), lambda i: stripped(F.substring(text, i * DETAIL_CHARS + 1, F.lit(DETAIL_CHARS))))
    return F.when(F.size(parts) >= 2, parts).otherwise(F.filter(pieces, lambda p: p != ""))


def morning_block(index: Column, title: Column, summary: Column, bullets: Column, focus: Column, time: Column) -> Column:
    """One item of a morning recap in markdown."""
    head = F.concat(F.lit("**"), index.cast("string"), F.lit(". "), stripped(F.coalesce(title, F.lit("未命名"))), F.lit("**\n"))
    f = stripped(F.coalesce(focus, F.lit("")))
    tail = F.concat(F.lit("\n关注："), F.when(f != "", f).otherwise("跟踪后续进展"), F.lit("\n北京时间："), time)
    body = let(stripped(F.coalesce(summary, F.lit(""))), lambda plain: F.when(is_long(plain), let(shortened(plain), lambda short: _long_body(plain, short, bullets))).otherwise(plain))
    return F.concat(head, body, tail)


def _long_body(plain: Column, short: Column, bullets: Column) -> Column:
    marked = F.filter(F.transform(F.coalesce(bullets, F.array().cast("array<string>")), lambda b: F.regexp_replace(stripped(b), r"^[•\-* ]+", "")), lambda b: b != "")
    pool = F.when(F.size(marked) > 0, marked).otherwise(split_details(plain))
    fresh = F.filter(pool, lambda d: ~F.contains(short, d))
    chosen = let(fresh, lambda x: F.when(F.size(x) > 0, x).otherwise(split_details(plain)))
    return let(detail_lines(chosen), lambda block: F.concat(short, F.when(block != "", F.concat(F.lit("\n📌 事件详情\n"), block)).otherwise("")))


def local_minute(instant: Column) -> Column:
    """'YYYY-MM-DD HH:MM' at +08:00."""
    wall = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(8), secs=F.unix_seconds(instant).cast("decimal(20,6)"))
    return F.coalesce(F.date_format(wall, "yyyy-MM-dd HH:mm"), F.lit("未知"))


def item_card(item: Column, published: Column, show_impact: Column) -> Column:
    """An item's card as JSON: header with colour and icon, time, overview, and the investment block if shown."""
    score = _score(item["score"])
    tier = F.when(score >= 9, F.lit("突发")).when(score >= 7, "重要").when(score >= 5, "一般").otherwise("低优")
    md = lambda content: F.struct(F.lit("div").alias("tag"), F.struct(F.lit("lark_md").alias("tag"), content.alias("content")).alias("text"))
    bullets = F.filter(F.transform(F.coalesce(item["summary_bullets"], F.array().cast("array<string>")), polished), lambda b: b != "")
    numbered = F.array_join(F.transform(F.slice(bullets, 1, 3), lambda b, i: F.concat(F.element_at(F.array(*[F.lit(x) for x in ("1️⃣ ", "2️⃣ ", "3️⃣ ")]), i + 1), b)), "\n")
    core = polished(item["summary"])
    overview = F.concat(F.lit("**📌 核心速览**\n"), F.when(F.size(bullets) > 0, numbered).otherwise(F.when(core != "", core).otherwise("暂无详细摘要要点")))
    time = F.concat(F.lit("🕒 **发布时间** "), local_minute(published), F.lit("（北京时间）\n🎚️ **紧急** **"), tier, F.lit("** "), flames(score))
    impact = F.when(show_impact, F.array(md(F.lit("**💹 投资影响**")))).otherwise(F.array().cast("array<struct<tag: string, text: struct<tag: string, content: string>>>"))
    header = F.struct(
        F.struct(F.lit("plain_text").alias("tag"), F.concat(F.coalesce(item["category"], F.lit(fixed.DEFAULT_CATEGORY)), F.lit("｜"), item["title"]).alias("content")).alias("title"),
        color(score).alias("template"),
        icon(score).alias("icon"),
    )
    return F.to_json(F.struct(F.lit("2.0").alias("schema"), header.alias("header"), F.concat(F.array(md(time), md(overview)), impact).alias("elements")))
