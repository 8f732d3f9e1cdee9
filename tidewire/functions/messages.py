"""Messages for delivery as JSON columns: a digest's overview, and an item with its bullets, impact table and advice.

An element of a message is a JSON text of its own, as elements differ in shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from . import cards
from .bind import let
from .text import stripped


def _or(value: Column, default: str) -> Column:
    """A stripped text, or the default where it is empty or null."""
    return let(stripped(F.coalesce(value, F.lit(""))), lambda v: F.when(v != "", v).otherwise(default))


def _text(content: Column) -> Column:
    return F.struct(F.lit("div").alias("tag"), F.struct(F.lit("lark_md").alias("tag"), content.alias("content")).alias("text"))


def _div(content: Column) -> Column:
    return F.to_json(_text(content))


def _rule() -> Column:
    return F.lit('{"tag":"hr"}')


def message(title: Column, subtitle: str, template: Column, elements: Column) -> Column:
    """A whole message of elements (an array of JSON texts)."""
    plain = lambda c: F.struct(F.lit("plain_text").alias("tag"), c.alias("content"))
    header = F.to_json(F.struct(plain(title).alias("title"), plain(F.lit(subtitle)).alias("subtitle"), template.alias("template")))
    return F.concat(F.lit('{"msg_type":"interactive","card":{"schema":"2.0","header":'), header, F.lit(',"body":{"elements":['), F.array_join(elements, ","), F.lit("]}}}"))


def digest_message(headline: Column, overview: Column, items: Column, material: Column, note: Column, subtitle: str = fixed.DIGEST_SUBTITLE) -> Column:
    """A digest: its overview, a block for each item with sources and four impacts, and what was filtered.

    items: array of structs with rank, category, title, channel, message_id, summary, impact_overall, impact_us, impact_cn and
    impact_commodities. Orange where there is material news with items, else blue."""

    def block(i: Column) -> Column:
        impacts = F.concat_ws("\n", *[F.concat(F.lit(label), _or(i[f"impact_{name}"], fixed.LITTLE_IMPACT)) for label, (_, name) in zip(fixed.IMPACT_LINES, fixed.IMPACT_ROWS, strict=True)])
        given = lambda c, default: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(default)
        head = F.concat(F.lit("**#"), i["rank"].cast("string"), F.lit(" ["), given(i["category"], fixed.DEFAULT_CATEGORY), F.lit("] "), given(i["title"], fixed.UNTITLED), F.lit("**\n"))
        source = F.concat(F.lit(fixed.SOURCE), F.ltrim(F.coalesce(i["channel"], F.lit("")), F.lit("@")), F.lit(" / #"), i["message_id"].cast("string"), F.lit("\n"))
        return _div(F.concat(head, source, F.coalesce(i["summary"], F.lit("")), F.lit("\n\n" + fixed.FOUR_IMPACTS), impacts))

    listed = F.coalesce(items, F.array().cast(items_type()))
    blocks = F.flatten(F.transform(listed, lambda i: F.array(_rule(), block(i))))
    noted = let(stripped(F.coalesce(note, F.lit(""))), lambda n: F.when(n != "", F.array(_div(F.concat(F.lit(fixed.FILTER_NOTE), n)))).otherwise(F.array().cast("array<string>")))
    elements = F.concat(F.array(_div(F.concat(F.lit(fixed.OVERVIEW), _or(overview, fixed.NO_OVERVIEW)))), blocks, noted)
    template = F.when(F.coalesce(material, F.lit(False)) & (F.size(listed) > 0), "orange").otherwise("blue")
    return message(_or(headline, fixed.HEADLINE), subtitle, template, elements)


def items_type() -> str:
    return "array<struct<rank: int, category: string, title: string, channel: string, message_id: bigint, summary: string, impact_overall: string, impact_us: string, impact_cn: string, impact_commodities: string>>"


def _tier(score: Column, place: int) -> Column:
    out = F.lit(fixed.TIERS[-1][place])
    for tier in reversed(fixed.TIERS[:-1]):
        out = F.when(score >= tier[0], tier[place]).otherwise(out)
    return out


def item_message(item: Column, score: Column, published: Column, flag: Column, subtitle: str = fixed.ITEM_SUBTITLE) -> Column:
    """An item: time and urgency, up to three bullets (further ones as details under a long summary), the impact table if the
    item may show it, and advice.

    item: struct with title, category, summary, summary_bullets, bias_* and impact_* for fixed.IMPACT_ROWS, and
    actionable_insight; score: 1 to 10 (ranking.item_score)."""
    category = _or(item["category"], fixed.DEFAULT_CATEGORY)
    bullets = F.filter(F.transform(F.coalesce(item["summary_bullets"], F.array().cast("array<string>")), cards.polished), lambda b: b != "")

    def overview(b: Column) -> Column:
        numbered = F.array_join(F.transform(F.slice(b, 1, 3), lambda x, i: F.concat((i + 1).cast("string"), F.lit("️⃣ "), x)), "\n")
        details = F.when(cards.is_long(item["summary"]) & (F.size(b) > 3), cards.detail_lines(F.slice(b, 4, 3))).otherwise("")
        core = let(cards.polished(item["summary"]), lambda c: F.when(c != "", c).otherwise(fixed.NO_BULLETS))
        return F.when(F.size(b) == 0, core).otherwise(F.concat(numbered, F.when(details != "", F.concat(F.lit(fixed.DETAIL_HEAD), details)).otherwise("")))

    def row(label: str, name: str) -> Column:
        cell = lambda width, content: F.struct(F.lit("column").alias("tag"), F.lit(width).alias("width"), F.lit("center").alias("vertical_align"), F.array(_text(content)).alias("elements"))
        cells = [cell("90px", F.lit(f"**{label}**")), cell("72px", F.concat(F.lit("**"), cards.bias(item[f"bias_{name}"]), F.lit("**"))), cell("weighted", _or(item[f"impact_{name}"], fixed.LITTLE_IMPACT))]
        return F.to_json(F.struct(F.lit("column_set").alias("tag"), F.lit("none").alias("flex_mode"), F.lit("4px").alias("horizontal_spacing"), F.array(*cells).alias("columns")))

    time = F.concat(F.lit(fixed.PUBLISHED), cards.local_minute(published), F.lit(fixed.LOCAL_CLOCK + fixed.URGENCY), _tier(score, 2), F.lit("** "), cards.flames(score))
    impact = F.array(_div(F.lit(fixed.INVESTMENT)), *[row(*r) for r in fixed.IMPACT_ROWS], _rule())
    shown = F.when(cards.shows_impact(score, category, flag), impact).otherwise(F.array().cast("array<string>"))
    first = F.array(_div(time), _rule(), _div(F.concat(F.lit(fixed.CORE), let(bullets, overview))), _rule())
    elements = F.concat(first, shown, F.array(_div(F.concat(F.lit(fixed.ADVICE), _or(item["actionable_insight"], fixed.DEFAULT_ADVICE)))))
    title = F.concat(_tier(score, 1), F.lit(" "), category, F.lit("｜"), _or(item["title"], fixed.UNTITLED))
    return message(title, subtitle, cards.color(score), elements)
