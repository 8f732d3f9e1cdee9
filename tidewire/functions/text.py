"""Text normalisation, fingerprints and event features.

Unicode normalisation and case folding aren't in Spark's functions; one Arrow-batched UDF computes all
features that depend on them in a single pass. Everything after it is column expressions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from .bind import let
from .types import struct

_NUMBER = re.compile(fixed.NUMBER, re.I)
_DIGIT = re.compile(r"\d")
_CJK = re.compile(r"[\u4e00-\u9fff]")
_TOKEN = re.compile(r"[a-z]{2,}|[\u4e00-\u9fff]+")
_PHRASES = sorted(fixed.TEMPLATE_PHRASES, key=len, reverse=True)
_GENERIC = frozenset(fixed.GENERIC_TOKENS)

#: White space as Python's str methods know it, as a Java character class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

FEATURES = "norm string, numbers array<string>, tokens array<string>, specific array<string>, event_key string"


def fold(text: str | None) -> str:
    """NFKC, case-folded, white space collapsed and stripped; null counts as empty."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def bucket(whole: str, fraction: str | None) -> str:
    """The magnitude of a number: its integer part from 1 on, two decimals below."""
    value = float(whole.replace(",", "") + "." + (fraction or "0"))
    return str(int(value)) if value >= 1 else f"{value:.2f}"


def features_of(text: str | None) -> tuple[str, list[str], list[str], list[str], str | None]:
    """Values of FEATURES for a text; arrays are sorted."""
    norm = fold(text)
    numbers, tokens = map(sorted, sets_of(norm))
    specific = [t for t in tokens if t not in _GENERIC]
    parts = specific + [f"#{n}" for n in numbers]
    return norm, numbers, tokens, specific, " ".join(parts) if len(parts) >= fixed.EVENT_KEY_MIN_PARTS else None


def sets_of(norm: str) -> tuple[set[str], set[str]]:
    """The numbers and the tokens of a text that fold() has given."""
    numbers, body = set(), norm
    if _DIGIT.search(norm):
        numbers = {bucket(*m.groups()) for m in _NUMBER.finditer(norm)}
        body = _NUMBER.sub(" ", norm)
    if _CJK.search(body):
        for phrase in _PHRASES:  # one after another, longest first: phrases overlap
            body = body.replace(phrase, " ")
    tokens = set(_TOKEN.findall(body))
    for run in [r for r in tokens if r[0] > "z" and len(r) > 1]:
        tokens.remove(run)
        tokens.update(map("".join, zip(run, run[1:], strict=False)))
    return numbers, tokens


def specific_of(tokens: set[str]) -> set[str]:
    return tokens - _GENERIC


@F.pandas_udf(struct(FEATURES))
def features(text: pd.Series) -> pd.DataFrame:
    """Struct of FEATURES."""
    return pd.DataFrame([features_of(t) for t in text], columns=["norm", "numbers", "tokens", "specific", "event_key"])


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """fold() of each text."""
    return text.map(fold)


def fingerprint(text: Column | str) -> Column:
    """SHA-256 of the normalised text, in lower-case hex."""
    return F.sha2(normalized(text), 256)


def pattern(*alternatives: str) -> str:
    """One Java pattern with Python's notion of case, \\w, \\s and \\b."""
    return "(?iuU)" + "|".join(f"(?:{a})" for a in alternatives)


def needles(regex: str) -> list[str] | None:
    """Lower-case texts of which every match holds at least one; None if the pattern doesn't show any."""
    inner = regex
    for edge in (r"\b", "(", r"\b"):
        inner = inner.removeprefix(edge)
    found = [re.match(r"[^\\()\[\]{}|*+?.^$]*", a.removeprefix(r"\b"))[0] for a in re.split(r"\|(?![^()]*\))", inner.removesuffix(r"\b").removesuffix(")"))]
    return [n.lower() for n in found] if all(found) and "(" not in inner else None


def any_match(text: Column, *patterns: str) -> Column:
    """Whether any of the patterns matches.

    A pattern is tried only on texts that hold one of its literal words, which is much cheaper to see."""
    def tried(low: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            hit = text.rlike(pattern(p))
            words = needles(p)
            if words:
                guard = F.contains(low, F.lit(words[0]))
                for w in words[1:]:
                    guard = guard | F.contains(low, F.lit(w))
                hit = guard & hit
            out = out | hit
        return out

    # three letters match an ASCII letter's other case but aren't lowered to it
    return let(F.lower(F.translate(text, "İıſ", "iis")), tried)


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def squeezed(text: Column | str) -> Column:
    """White space collapsed to single blanks and stripped."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def blob(title: Column | str, summary: Column | str) -> Column:
    """'title: summary', or the one that isn't empty."""
    t, s = stripped(F.coalesce(title, F.lit(""))), stripped(F.coalesce(summary, F.lit("")))
    return F.when((t != "") & (s != ""), F.concat(t, F.lit(": "), s)).otherwise(F.concat(t, s))


def reader_blob(title: Column, summary: Column, bullets: Column) -> Column:
    """blob() and the bullets that aren't empty."""
    kept = F.filter(F.transform(F.coalesce(bullets, F.array().cast("array<string>")), stripped), lambda b: b != "")
    return F.array_join(F.filter(F.concat(F.array(blob(title, summary)), kept), lambda p: p != ""), " ")


def lead_title(text: Column, most: int = fixed.LEAD_TITLE_MAX) -> Column:
    """The first clause by the first kind of mark that gives one, cut to `most` characters."""
    s = F.regexp_replace(squeezed(F.coalesce(text, F.lit(""))), r"^[•\-* ]+", "")
    return let(let(s, _first_clause), lambda x: F.when(F.length(x) > most, F.rtrim(F.substring(x, 1, most))).otherwise(x))


def _first_clause(s: Column) -> Column:
    out = s
    for mark in ("，", "；", "？", "！", "。"):
        head = stripped(F.substring_index(s, mark, 1))
        out = F.when(s.contains(mark) & (head != ""), head).otherwise(out)
    return out


def clauses(text: Column) -> Column:
    """Clauses of at least six characters and the whole text, each once, in order."""
    t = F.coalesce(text, F.lit(""))
    cut = F.transform(F.split(t, fixed.CLAUSE_MARKS), lambda c: F.regexp_replace(c, "^[ ，,、:：]+|[ ，,、:：]+$", ""))
    whole = squeezed(t)
    return F.array_distinct(F.concat(F.filter(cut, lambda c: F.length(c) >= 6), F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))))


def photo_urls(urls: Column) -> Column:
    """http(s) links that don't point into the message service, each once, in order."""
    kept = F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: stripped(F.coalesce(u, F.lit("")))), lambda u: F.lower(u).rlike("^https?://") & ~u.rlike(pattern(fixed.MESSAGE_LINK)))
    return F.array_distinct(kept)


def without_traces(text: Column) -> Column:
    """Without links into the message service, white space squeezed."""
    return squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), pattern(fixed.MESSAGE_LINK), ""))


def caption(text: Column, most: int = fixed.CAPTION_MAX) -> Column:
    """A complete sentence or more of at most `most` characters, without an ellipsis at the end."""
    s = F.regexp_replace(without_traces(text), r"^[•\-* ]+", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?:\.{2,}|…+|⋯+)$", ""), r"[ .．⋯]+$", ""))
    closed = let(s, lambda x: F.when(x == "", "").when(x.rlike("[。！？；]$"), x).otherwise(F.concat(x, F.lit("。"))))
    return let(closed, lambda x: F.when(F.length(x) <= most, x).otherwise(_within(x, most)))


def _within(closed: Column, most: int) -> Column:
    window = F.substring(closed, 1, most)
    cut = F.rtrim(F.regexp_replace(window, r"[ .．…⋯]+$", ""))
    out = F.when(cut == "", "").when(cut.rlike("[。！？；]$"), cut).otherwise(_closed_cut(cut, most))
    for mark in ("；", "？", "！", "。"):  # the last one tested first wins
        at = _last(window, mark)
        out = F.when(at >= 9, F.substring(window, F.lit(1), at)).otherwise(out)
    return out


def _closed_cut(cut: Column, most: int) -> Column:
    short = F.rtrim(F.substring(cut, 1, most - 1))
    return F.when(short == "", "").otherwise(F.concat(short, F.lit("。")))


def _last(text: Column, mark: str) -> Column:
    """Position (from 1) of the last occurrence, 0 if there is none."""
    at = F.instr(F.reverse(text), mark)
    return F.when(at > 0, F.length(text) - at + 1).otherwise(0)
