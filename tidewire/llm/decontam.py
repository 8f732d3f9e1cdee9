"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items become template tokens: numbers, names and units are replaced by
typed placeholders, other words are lower-cased without the punctuation around them. Windows of template
tokens are hash-joined. For every matched window the values behind the placeholders are compared: along
one alignment of a document with an item, a value of the item must always stand for the same value in
the document, else the window doesn't count. Re-parameterised questions (other numbers, other names) are
so caught, and chance matches of number-heavy templates aren't.

An item is found in a document if the windows that count cover at least `coverage` of its windows. Items
with fewer tokens than a window are one window of their own length. Windows need some tokens that aren't
placeholders, so that chance matches of number-heavy templates don't count.

Items of one window, and items without a window that is good enough (a sum, a list of names, two words), are also
looked for as they are: windows of the same length over lower-cased words. So every item with a token is found
where it is copied, whatever it holds. The first word of an item is tried both as the start of a sentence and inside one.

Documents are scanned once; only windows whose hash is in a bitmap (built from all benchmark windows, of a size that
goes with their number up to a bound) leave the scan, and the join decides about them. A document and an item meet
first by the item's rarest windows, of which any document that covers enough must hold one; so windows that many items
share (a common instruction) don't bring all of them together. All windows are compared only for those that met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .neardup import mix

WINDOW, COVERAGE = 8, 0.5
#: A window needs so many tokens that aren't placeholders, or half of them if it is shorter.
LITERALS = 4
#: Bits of the bitmap: 16 for each benchmark window within these bounds, so it is 8 MB at most.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 26
TEMPLATE, EXACT = 0, 1

UNITS = frozenset(
    "kg g mg lb lbs oz ton tons tonne tonnes km cm mm mi mile miles meter meters metre metres foot feet inch inches yard yards "
    "ml liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros pound pounds cent cents usd eur gbp percent % $ € £ mph kmh kph watt watts volt volts degree degrees "
    "jahr jahre tag tage stunde stunden an ans jour jours heure heures año años día días hora horas".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*")
_NUMBER_UNIT = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*([^\W\d_]+|[%$€£°])")
LITERAL, NUMBER, UNIT, NAME = range(4)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]


_AROUND = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "$%") + "…«»“”„‘’–—¿¡"
_CLOSERS, _ENDS = "'\")]»”’*_", ".!?:…"


def classify(word: str) -> tuple[str | None, int, str | None, int, bool]:
    """A white-space word's template token and kind at the start of a sentence, the same elsewhere, and whether it ends one.

    A token of None: the word holds only punctuation."""
    ends = word.rstrip(_CLOSERS)[-1:] in _ENDS and word[-1:] != ""
    core = word.strip(_AROUND)
    low = core.lower()
    if core.isalpha():
        if low in UNITS:
            return "<unit>", UNIT, "<unit>", UNIT, ends
        if core[0].isupper() and not core.isupper():
            return low, LITERAL, "<name>", NAME, ends
        return low, LITERAL, low, LITERAL, ends
    if not any(c.isalnum() for c in core):
        if core in UNITS:
            return "<unit>", UNIT, "<unit>", UNIT, ends
        return None, LITERAL, None, LITERAL, ends
    if _NUMBER.fullmatch(core):
        return "<number>", NUMBER, "<number>", NUMBER, ends
    if (m := _NUMBER_UNIT.fullmatch(core)) and m[1].lower() in UNITS | {"°"}:
        return "<number><unit>", NUMBER, "<number><unit>", NUMBER, ends
    return low, LITERAL, low, LITERAL, ends


class _Words(dict):
    """Numbers of words; their classes are held in arrays by number."""

    BOUND = 250_000

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows: list[tuple] = []  # not in the arrays yet
        self.n = 0
        self.arrays = tuple(np.empty(1 << 12, dtype=t) for t in (np.uint64, np.uint64, np.int8, np.int8, bool, bool, np.uint64))

    def __missing__(self, word: str) -> int:
        start, k1, mid, k2, ends = classify(word)
        h1 = 0 if start is None else xxhash.xxh64_intdigest(start)
        h2 = h1 if mid is start else xxhash.xxh64_intdigest(mid)
        exact = h1 if k1 == LITERAL else xxhash.xxh64_intdigest(word.strip(_AROUND).lower())
        self.rows.append((h1, h2, k1, k2, ends, start is None, exact))
        self[word] = n = self.n + len(self.rows) - 1
        return n

    def of(self, words: list[str]) -> tuple:
        if len(self) > self.BOUND:
            self.reset()
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        if self.rows:
            size = self.n + len(self.rows)
            if size > len(self.arrays[0]):
                self.arrays = tuple(np.concatenate([a, np.empty(max(len(a), size), dtype=a.dtype)]) for a in self.arrays)
            for a, column in zip(self.arrays, zip(*self.rows, strict=True), strict=True):
                a[self.n : size] = column
            self.n, self.rows = size, []
        return tuple(a[ids] for a in self.arrays)


_words = _Words()


def template(text: str | None, inside: bool = False) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """A text's template: token hashes, kinds, white-space words, the word of each token, and hashes of the tokens as they are.

    inside: take the first word as one inside a sentence."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int8), words, np.empty(0, np.int64), np.empty(0, np.uint64)
    h1, h2, k1, k2, ends, skip, exact = _words.of(words)
    start = np.append(not inside, ends[:-1])
    hashes, kinds = np.where(start, h1, h2), np.where(start, k1, k2)
    where = np.flatnonzero(~skip)
    return hashes[where], kinds[where], words, where, exact[where]


def window_hashes(hashes: np.ndarray, length: int, kind: int) -> np.ndarray:
    """Hash of the window of `length` tokens at each position."""
    n = len(hashes) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    x = np.full(n, 2 * length + kind, dtype=np.uint64)
    for k in range(length):
        x += hashes[k : k + n] * _POWERS[k]
    return mix(x)


def good_windows(kinds: np.ndarray, length: int) -> np.ndarray:
    """Whether the template window at each position has enough tokens that aren't placeholders."""
    literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    return literal[length:] - literal[:-length] >= min(LITERALS, (length + 1) // 2)


def _slots(words: list[str], where: np.ndarray, kinds: np.ndarray, at: int, length: int) -> list[str]:
    return [f"{kinds[i]}{words[where[i]].strip('.,;:!?')}" for i in range(at, at + length) if kinds[i] != LITERAL]


def item_windows(item: int, text: str | None, window: int) -> list[tuple]:
    """item_id, kind, pos, n (the item's windows of that kind), length, hash and slots of each window of an item."""
    rows, exact = [], []
    good = np.zeros(0, bool)
    for inside in (False, True):
        hashes, kinds, words, where, exact = template(text, inside)
        length = min(window, len(hashes))
        if not length:
            return []
        fits = good_windows(kinds, length)
        if not inside:
            good = fits
        x = window_hashes(hashes, length, TEMPLATE)
        for p in np.flatnonzero(fits if not inside else fits[:1] & good[:1]):
            rows.append((item, TEMPLATE, int(p), int(good.sum()), length, int(x[p].view(np.int64)), _slots(words, where, kinds, p, length)))
    if len(good) == 1 or not good.any():
        x = window_hashes(exact, length, EXACT)
        rows += [(item, EXACT, p, len(x), length, int(v), []) for p, v in enumerate(x.view(np.int64))]
    return rows


WINDOWS = "item_id long, kind int, pos long, n long, length long, hash long, slots array<string>"


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_windows() of each item; equal rows once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for item, text in zip(frame["item_id"], frame["text"], strict=True) for r in item_windows(item, text, window)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    return benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text").mapInPandas(run, WINDOWS).distinct()


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A bitmap of all window hashes, and the kinds and lengths that occur; both of bounded size."""
    size = LEAST_BITS
    while size < min(MOST_BITS, 16 * windows.count()):
        size *= 2
    words = windows.groupBy(F.floor(F.pmod("hash", F.lit(size)) / 64).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(hash, {size}) % 64 AS INT))")).alias("bits"))
    out = np.zeros(size // 64, dtype=np.int64)
    found = words.toPandas()  # MOST_BITS / 64 rows at most
    out[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool), sorted((r[0], r[1]) for r in windows.select("kind", "length").distinct().collect())


FOUND = "doc_id long, copy long, at long, kind int, hash long, doc_slots array<string>"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The items found in each document: doc_id, copy (hash of the text), item_id, coverage.

    docs: doc_id and text; benchmark: item_id and text; other columns are ignored. Null and empty texts
    hold and match nothing; rows with a null item_id are ignored, those with a null doc_id are matched
    like others. Repeated rows give their matches once. Rows that share an item_id but not the text are items of
    one name: the windows of all count. An item of a word or two is found in every document that holds it.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    items = common.materialize(benchmark_windows(benchmark, window), "benchmark")
    bits, looks = _bitmap(items)
    sent = spark.sparkContext.broadcast(np.packbits(bits))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(sent.value).view(bool)
        size = np.uint64(len(bits))
        for frame in frames:
            rows = []
            for doc, copy, text in zip(frame["doc_id"].astype("Int64"), frame["copy"], frame["text"], strict=True):
                hashes, kinds, words, where, exact = template(text)
                for kind, length in looks:
                    x = window_hashes(exact if kind == EXACT else hashes, length, kind)
                    hit = bits[(x % size).astype(np.int64)]
                    if kind == TEMPLATE and len(x):
                        hit &= good_windows(kinds, length)
                    for p in np.flatnonzero(hit):
                        rows.append((doc, copy, int(p), kind, int(x[p].view(np.int64)), [] if kind == EXACT else _slots(words, where, kinds, p, length)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text")
    found = texts.mapInPandas(run, FOUND).distinct()
    found = common.materialize(found.join(items.select("kind", "hash").distinct(), ["kind", "hash"], "left_semi"), "windows")

    # of an item's windows the rarest among items, one more than may be missing
    sharing = items.select("kind", "hash", "item_id").distinct().groupBy("kind", "hash").agg(F.count("*").alias("sharing"))
    places = items.groupBy("kind", "item_id", "pos", "n", "hash").agg(F.lit(1)).join(sharing, ["kind", "hash"]).groupBy("kind", "item_id", "pos").agg(F.max("n").alias("n"), F.max("sharing").alias("sharing"), F.collect_set("hash").alias("hashes"))
    rank = F.row_number().over(Window.partitionBy("kind", "item_id").orderBy("sharing", "pos"))
    rare = places.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(coverage) - 1e-9) + 1)
    rare = rare.select("kind", "item_id", F.explode("hashes").alias("hash")).groupBy("kind", "hash").agg(F.collect_set("item_id").alias("ids"))
    holders = found.select("kind", "hash", "doc_id", "copy").distinct()
    met = common.salted_join(holders, rare, ["kind", "hash"]).select("kind", "doc_id", "copy", F.explode("ids").alias("item_id")).distinct()
    # the items of a document, with it; then all windows of both
    own = ["kind", "doc_id", "copy", "hash"]
    wanted = common.salted_join(met, items.groupBy("kind", "item_id").agg(F.collect_list(F.struct("pos", "n", "hash", "slots")).alias("w")), ["kind", "item_id"])
    wanted = wanted.select("kind", "doc_id", "copy", "item_id", F.explode("w").alias("w")).select("kind", "doc_id", "copy", "item_id", "w.*")
    f = found.select(*[F.col(c).alias(f"f_{c}") for c in own], "at", "doc_slots")
    pairs = wanted.join(f, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in own]).withColumn("shift", F.col("at") - F.col("pos"))
    pairs = common.materialize(pairs.where("size(slots) = size(doc_slots)").select("kind", "doc_id", "copy", "item_id", "shift", "pos", "n", "slots", "doc_slots"), "matches")
    align = ["kind", "doc_id", "copy", "item_id", "shift"]
    said = pairs.where("size(slots) > 0").select(*align, F.explode(F.arrays_zip("slots", "doc_slots")).alias("s")).select(*align, F.col("s.slots").alias("slot"), F.col("s.doc_slots").alias("value")).distinct()
    broken = said.groupBy(*align, "slot").count().where("count > 1").groupBy(*[F.col(c).alias(f"b_{c}") for c in align]).agg(F.collect_set("slot").alias("broken"))
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in align]
    counted = pairs.join(broken, same, "left").where(F.col("broken").isNull() | ~F.arrays_overlap("slots", "broken")).select(*align[:4], "pos", "n")
    by_kind = counted.groupBy(*align[:4]).agg((F.countDistinct("pos") / F.max("n")).alias("coverage"))
    return by_kind.groupBy("doc_id", "copy", "item_id").agg(F.max("coverage").alias("coverage")).where(F.col("coverage") >= coverage)


def flagged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, copy, items (sorted) and the largest coverage of each document that holds an item."""
    found = contaminated(docs, benchmark, window, coverage)
    return found.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    return common.without(docs, flagged(docs, benchmark, window, coverage))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, kept (no item found), items and coverage."""
    docs = common.table(spark, sf_dir, "documents")
    bad = flagged(docs, common.table(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", "bad_id")
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("doc_copy"))
    out = all_docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("doc_copy") == F.col("copy")), "left")
    return out.select("doc_id", F.col("items").isNull().alias("kept"), "items", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
