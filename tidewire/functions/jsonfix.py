"""Evaluator output: tolerant JSON parsing and normalisation to records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .bind import let
from .text import squeezed, stripped

EVALUATION = "score int, is_news boolean, is_spam boolean, title string, summary_bullets array<string>, key_takeaways array<string>, category string, actionable_insight string"


def without_fences(text: Column) -> Column:
    """The inside of a ``` block, or the text, stripped."""
    s = stripped(F.coalesce(text, F.lit("")))
    fence = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
    return F.when(s.rlike(fence), stripped(F.regexp_extract(s, fence, 1))).otherwise(s)


def outer_object(text: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    first, back = F.instr(text, "{"), F.instr(F.reverse(text), "}")
    last = F.length(text) - back + 1
    return F.when((first > 0) & (back > 0) & (last > first), F.substring(text, first, last - first + 1))


def repaired(text: Column) -> Column:
    """Without trailing commas, and with JSON's words for True, False and None."""
    s = F.regexp_replace(stripped(text), r"(?U),\s*([}\]])", "$1")
    for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
        s = F.regexp_replace(s, rf"(?U)\b{python}\b", json)
    return s


def parsed(text: Column) -> Column:
    """A variant holding an object: the whole text, its outer object or that repaired; else null."""
    def tried(clean: Column, inner: Column) -> Column:
        return F.coalesce(*[let(F.try_parse_json(x), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)) for x in (clean, inner, repaired(inner))])

    return let(without_fences(text), lambda clean: let(outer_object(clean), lambda inner: tried(clean, inner)))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _present(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def _truthy(v: Column, path: str) -> Column:
    """Whether a value counts as true: any text, array or object that isn't empty, any number but 0."""
    raw = _text(v, path)

    def true(kind: Column) -> Column:
        return (
            F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
            .when(kind == "STRING", raw != "")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~raw.isin("[]", "{}"))
            .when(kind == "VOID", F.lit(False))
            .otherwise(raw.try_cast("double") != 0)
        )

    return F.coalesce(let(_kind(v, path), true), F.lit(False))


def _lines(v: Column, path: str) -> Column:
    """Bullets of a text (one a line, without list marks) or of an array."""
    by_line = F.transform(F.filter(F.split(_text(v, path), r"\r\n|\n|\r"), lambda x: stripped(x) != ""), lambda x: F.regexp_replace(stripped(x), r"^[•\-*0-9. ]+", ""))
    by_item = F.filter(F.transform(F.try_variant_get(v, path, "array<string>"), stripped), lambda x: x != "")
    kind = _kind(v, path)
    return F.when(kind == "STRING", by_line).when(kind.startswith("ARRAY"), by_item)


def _first(*arrays: Column, default: Column) -> Column:
    out = default
    for a in reversed(arrays):
        out = F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, a).otherwise(out)
    return out


def normalised(v: Column, fallback_title: Column | None = None) -> Column:
    """A struct of EVALUATION from an object variant; null for null.

    Scores are clamped to 1..10, other spellings of fields accepted, spam forced to a score of 2 at most."""
    return let(v, lambda x: F.when(x.isNotNull(), _record(x, fallback_title)))


def _record(v: Column, fallback_title: Column | None) -> Column:
    raw = F.when(_present(v, "$.score") & (_kind(v, "$.score") != "VOID"), _text(v, "$.score")).when(_present(v, "$.urgency_score"), _text(v, "$.urgency_score")).otherwise(F.lit("5"))
    spare = stripped(F.coalesce(fallback_title, F.lit(""))) if fallback_title is not None else F.lit("")
    title = let(stripped(F.coalesce(_text(v, "$.title"), F.lit(""))), lambda own: F.when(own != "", own).when(spare != "", spare).otherwise(fixed.DEFAULT_TITLE))
    title = let(title, lambda t: F.when(F.length(t) > 100, F.concat(F.substring(t, 1, 97), F.lit("..."))).otherwise(t))
    bullets = F.when(_present(v, "$.summary_bullets") & (_kind(v, "$.summary_bullets") != "VOID"), _lines(v, "$.summary_bullets")).otherwise(_lines(v, "$.summary_points"))
    insight = let(stripped(_text(v, "$.actionable_insight")), lambda x: F.when(x != "", x))
    takeaways = let(_lines(v, "$.key_takeaways"), lambda x: _first(x, default=F.array(F.lit(fixed.DEFAULT_TAKEAWAY))))

    def finished(score: Column, spam: Column, category: Column, title: Column) -> Column:
        news = F.when(_present(v, "$.is_news"), _truthy(v, "$.is_news")).otherwise((score >= 5) & ~category.isin(fixed.CHAT_CATEGORY, fixed.SPAM_CATEGORY))
        return F.struct(
            F.when(spam, F.least(score, F.lit(2))).otherwise(score).alias("score"),
            (~spam & news).alias("is_news"),
            spam.alias("is_spam"),
            title.alias("title"),
            let(bullets, lambda b: _first(b, default=F.array(title))).alias("summary_bullets"),
            takeaways.alias("key_takeaways"),
            F.when(spam, fixed.SPAM_CATEGORY).otherwise(category).alias("category"),
            insight.alias("actionable_insight"),
        )

    def categorised(score: Column, spam: Column) -> Column:
        category = let(
            stripped(F.coalesce(_text(v, "$.category"), F.lit(""))),
            lambda c: F.when(c.isin(*fixed.CATEGORIES), c).when(spam, fixed.SPAM_CATEGORY).when(score >= 7, fixed.URGENT_CATEGORY).otherwise(fixed.DEFAULT_CATEGORY),
        )
        return let(category, lambda c: let(title, lambda t: finished(score, spam, c, t)))

    return let(let(raw, _clamped), lambda score: let(_truthy(v, "$.is_spam"), lambda spam: categorised(score, spam)))


def _clamped(raw: Column) -> Column:
    """A score as an integer between 1 and 10; 5 where it isn't a number."""
    number = F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("long")).when(raw.rlike(r"^[+-]?\d+\.\d*$"), raw.try_cast("double").cast("long")).when(raw == "true", 1).when(raw == "false", 0)
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(number, F.lit(5)))).cast("int")


ITEM = "rank int, message_id long, channel string, title string, summary string, summary_bullets array<string>, score int, category string, event_at string, is_update boolean, update_reason string"
BRIEF = f"headline string, overview string, has_material_news boolean, items array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ITEM.split(', '))}>>"


def brief(text: Column, most: int = 5) -> Column:
    """A digest of at most `most` items; null unless the text is strict JSON and every item is valid."""
    clean = without_fences(text)
    whole = F.when(F.schema_of_variant(F.try_parse_json(clean)).startswith("OBJECT"), F.from_json(clean, BRIEF))
    items = F.slice(F.coalesce(whole["items"], F.array().cast(f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ITEM.split(', '))}>>")), 1, most)
    valid = F.forall(items, lambda i: i["message_id"].isNotNull() & i["channel"].isNotNull() & F.coalesce(i["rank"].between(1, 5), F.lit(False)) & F.coalesce(i["score"].between(1, 10), F.lit(True)))
    out = F.struct(whole["headline"].alias("headline"), whole["overview"].alias("overview"), ((F.size(items) > 0) & F.coalesce(whole["has_material_news"], F.lit(True))).alias("has_material_news"), items.alias("items"))
    return F.when(whole.isNotNull() & valid, out)


def envelope(text: Column) -> Column:
    """The message content of a chat completion, or the whole text."""
    return F.coalesce(F.get_json_object(text, "$.choices[0].message.content"), text)


def redacted(text: Column) -> Column:
    """With secrets of key=value, bearer and webhook form replaced."""
    s = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;&]+", "$1***")
    s = F.regexp_replace(s, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1***")
    return F.regexp_replace(s, r"(https?://[^\s]*/hook/)[A-Za-z0-9-]+", "$1***")


def channel_list(text: Column) -> Column:
    """Channels of a comma-separated text or a JSON array: lower case, without leading @, each once."""
    names = F.coalesce(F.when(stripped(text).startswith("["), F.from_json(text, "array<string>")), F.split(text, r"[,\n]"))
    clean = F.transform(names, lambda c: F.regexp_replace(F.lower(squeezed(c)), "^@+", ""))
    return F.array_distinct(F.filter(clean, lambda c: c != ""))
