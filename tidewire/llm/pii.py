"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Base kinds (always reported once their check holds): email, ip (parts up to 255), card (16 to 19 digits
passing Luhn), phone (8 to 15 digits). Added kinds, reported where their score reaches `REPORT_FROM`:
iban (mod-97), ssn (valid ranges; its score needs a context word). An added span that overlaps a base span is left out.

Candidates are found in linear time: possessive patterns never give back what they took, and e-mail
addresses are read leftwards and rightwards from each @.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn")
REPORT_FROM, NEAR = 0.6, 40
#: Score of a confirmed span by kind, and what a context word within NEAR characters adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "ssn": ("ssn", "social", "security"),
}
BONUS = 0.3

_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The Luhn checksum over decimal digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of an account number without blanks."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, start if start == at else at)
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + length
            at += length + 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if 15 <= len(s := m[0].replace(" ", "")) <= 34 and mod97(s):
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": lambda t: (m.span() for m in _SSN.finditer(t))}


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    return SCORES[kind] + BONUS * any(re.search(rf"(?<!\w){w}", around) for w in CONTEXT[kind])


def find(text: str | None) -> list[Span]:
    """All spans of a text by kind, then start; positions count code points. A null text has none."""
    if not text:
        return []
    out = []
    has_digit = _DIGIT.search(text) is not None
    for kind in BASE:
        if "@" in text if kind == "email" else has_digit and (kind != "phone" or "+" in text):
            out += [Span(kind, a, b, min(1.0, _score(kind, text, a, b))) for a, b in _FIND[kind](text)]
    if has_digit:
        taken = sorted((s.start, s.end) for s in out)
        for kind in ADDED:
            for a, b in _FIND[kind](text):
                if (score := _score(kind, text, a, b)) >= REPORT_FROM and not any(s < b and a < e for s, e in taken):
                    out.append(Span(kind, a, b, min(1.0, score)))
    return out


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) for each row of docs.

    Null and empty texts have none; texts of any length are read whole; rows are read one by one, so
    repeated rows and null ids don't matter; other columns are ignored."""
    common.small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find(t)] for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "spans": spans})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts and digest of the base spans, and all spans as text."""
    found = detect(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
