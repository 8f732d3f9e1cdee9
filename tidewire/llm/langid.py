"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the substrings of that text. A
document is cut into phrases, each the longest one that the automaton accepts (or a single unknown
symbol); the entropy per symbol under a language is (phrases * log2 of the training text's length) /
symbols. The language with the fewest phrases, so normalised, wins.

Text is reduced to its letters (with their combining marks) in lower case and single blanks for all else,
and is read as UTF-8 bytes, so that automata have few symbols in any script. Phrases run across words.

Parsing is the same for all texts and languages at once: texts are cut into lanes of `LANE` symbols that
step together through one table of all automata. Lanes after a text's first start as if a phrase began
there; then each is parsed again from the state in which the lane before it really ends, until both parses
are in the same state, from where on they agree. So counts are those of parsing a text from end to end.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import remainder

#: Bounds of the training sample for each language: documents (chosen by a hash), letters and blanks taken from one
#: of them, bytes in all. All languages together learn from TOTAL bytes at most, in equal parts; none is left out.
DOCUMENTS, EXCERPT, CHARACTERS, TOTAL = 80, 3_000, 80_000, 1_000_000
UNKNOWN = "und"
#: Symbols in a lane, and bytes of text parsed at once.
LANE, SLICE = 256, 4_000_000

_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 combining mark."""
    if not _kinds:
        first = (unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
        _kinds.append(np.fromiter(({"L": 1, "M": 2}.get(c, 0) for c in first), dtype=np.uint8, count=sys.maxunicode + 1))
    return _kinds[0]


def letters(text: str | None) -> bytes:
    """A text's letters in lower case, in UTF-8, with a blank before, between and after runs of them; empty without letters."""
    raw = (text or "").lower().encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, dtype=np.uint32)
    kind = _kind()[points]
    if not (kind == 1).any():
        return b""
    keep = kind > 0
    gap = ~keep
    gap[1:] &= keep[:-1]  # the first of each run of others
    shown = keep | gap
    out = np.where(keep, points, 32)[shown].astype("<u4").tobytes().decode("utf-32-le")
    return f" {out.strip(' ')} ".encode()


def automaton(text) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start and every state accepts."""
    step: list[dict] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        now = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return step


class Parser:
    """Counts the phrases of texts under several automata.

    One flat table: a state is the place of its row; the entry of a symbol is four times the next state, plus 1 if a
    phrase ends before the symbol, plus 2 if the symbol is unknown. Restarts are in the table: a symbol that doesn't continue a phrase ends it and
    leads where the start state leads, or, if the language doesn't have it, is a phrase of its own."""

    def __init__(self, texts: list[bytes]):
        used = sorted(set(b"".join(texts)))
        self.symbol = np.full(256, len(used), dtype=np.uint8)  # any other byte
        self.symbol[used] = np.arange(len(used))
        self.pad = len(used) + 1
        width = self.pad + 1
        steps = [automaton(t) for t in texts]
        self.roots = np.cumsum([0] + [len(s) for s in steps[:-1]]) * width if texts else np.zeros(0, np.int64)
        self.table = np.empty((sum(map(len, steps)), width), dtype=np.int32)
        at = 0
        for s, root in zip(steps, self.roots.tolist(), strict=True):
            start = np.full(width, 4 * root + 2, dtype=np.int64)  # an unknown symbol: a phrase, and the start again
            for c, q in s[0].items():
                start[self.symbol[c]] = 4 * (root + q * width)
            rows = self.table[at : at + len(s)]
            rows[0] = start
            rows[1:] = start + 1  # the phrase so far ends
            state = np.repeat(np.arange(len(s)), [len(x) for x in s])
            symbols = self.symbol[np.fromiter((c for x in s for c in x), dtype=np.int64, count=len(state))]
            rows[state, symbols] = 4 * (root + width * np.fromiter((q for x in s for q in x.values()), dtype=np.int64, count=len(state)))
            rows[:, self.pad] = 4 * (root + width * np.arange(len(s)))
            at += len(s)
        self.table = self.table.ravel()

    def _run(self, lanes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each lane (rows: symbols in order, columns: lanes) from the given states, and the states at its end."""
        n = np.zeros(state.shape, dtype=np.int32)
        for symbols in lanes:
            v = self.table[state + symbols[:, None]]
            # at most an ended phrase (bit 0) and one unknown symbol (bit 1)
            n += (v & 1) + (v >> 1 & 1)
            state = v >> 2
        return n, state

    def _mend(self, lanes: np.ndarray, true: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For single lanes: phrases of the parse from `true` less those of the parse from `root`, both until they meet; the
        true end state; and whether they met."""
        n, end, met = np.zeros(len(true), dtype=np.int64), np.zeros(len(true), dtype=np.int32), true == root
        left = np.flatnonzero(~met)
        a, b, own = true[left].astype(np.int32), root[left].astype(np.int32), lanes[:, left]
        for k in range(len(lanes)):
            if not len(left):
                break
            x, y = self.table[a + own[k]], self.table[b + own[k]]
            n[left] += (x & 1) + (x >> 1 & 1) - (y & 1) - (y >> 1 & 1)
            a, b = x >> 2, y >> 2
            same = a == b
            if same.any():
                met[left[same]] = True
                left, a, b, own = left[~same], a[~same], b[~same], own[:, ~same]
        end[left] = a
        return n, end, met

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text under each automaton."""
        out = np.zeros((len(texts), len(self.roots)), dtype=np.int64)
        some = [k for k, t in enumerate(texts) if t]
        if not some or not len(self.roots):
            return out
        lengths = np.array([-(-len(texts[k]) // LANE) for k in some])  # lanes of each text
        first = np.cumsum(lengths) - lengths
        flat = np.full(int(lengths.sum()) * LANE, self.pad, dtype=np.uint8)
        for k, f in zip(some, first.tolist(), strict=True):
            flat[f * LANE : f * LANE + len(texts[k])] = self.symbol[np.frombuffer(texts[k], dtype=np.uint8)]
        lanes = np.ascontiguousarray(flat.reshape(-1, LANE).T).astype(np.int32)
        root = np.tile(self.roots.astype(np.int32), (lanes.shape[1], 1))
        n, end = self._run(lanes, root)
        n = n.astype(np.int64)
        spoken = end.copy()  # the end of a lane that starts at the root
        todo = np.ones(lanes.shape[1], dtype=bool)
        todo[first] = False
        base, todo = n.copy(), np.repeat(todo[:, None], len(self.roots), axis=1)
        while todo.any():
            lane, lang = np.nonzero(todo)
            diff, mended, met = self._mend(lanes[:, lane], end[lane - 1, lang], root[lane, lang])
            n[lane, lang] = base[lane, lang] + diff
            now = np.where(met, spoken[lane, lang], mended)
            moved = now != end[lane, lang]
            end[lane, lang] = now
            todo[:] = False  # a lane whose end moved changes the one after it, if that is of the same text
            lane, lang = lane[moved] + 1, lang[moved]
            inside = lane < len(todo)
            todo[lane[inside], lang[inside]] = True
            todo[first] = False
        out[some] = np.add.reduceat(n, first, axis=0)
        out[some] += end[first + lengths - 1] != root[0]  # the last phrase ends with the text
        return out


@dataclass
class Model:
    """Training text of each language as letters(), in order of their names."""

    texts: dict[str, bytes]
    _parser: Parser | None = field(default=None, repr=False)

    def __getstate__(self):  # automata are built again where they are needed
        return {"texts": self.texts, "_parser": None}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and a score for each text; UNKNOWN and 0 for texts without letters."""
        if self._parser is None:
            self._parser = Parser(list(self.texts.values()))
        out: list[tuple[str, float]] = []
        held: list[bytes] = []
        for t in texts:
            held.append(letters(t))
            if sum(map(len, held)) >= SLICE:
                out += self._judge(held)
                held = []
        return out + self._judge(held)

    def _judge(self, clean: list[bytes]) -> list[tuple[str, float]]:
        names, cost = list(self.texts), np.log2([len(t) + 2 for t in self.texts.values()])
        out = []
        for t, n in zip(clean, self._parser.counts(clean), strict=True):
            if not t or not names:
                out.append((UNKNOWN, 0.0))
                continue
            bits = n * cost
            best = int(np.argmin(bits))
            # short texts differ by a few phrases and so stay uncertain; long ones are compared per 200 symbols
            odds = np.exp(-(bits - bits[best]) * min(1.0, 200 / len(t)) * np.log(2))
            out.append((names[best], float(1 / odds.sum())))
        return out


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of docs; rows where either is null, or the text has no letter, teach nothing.

    Every lang value is learned, the rare ones too: with many of them each gets an equal part of TOTAL."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text").where(F.col("text").rlike(r"\p{L}"))
    total = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row for each language
    if not total:
        return Model({})
    rate = F.create_map(*[F.lit(v) for r in total for v in (r.lang, min(1.0, 4 * DOCUMENTS / r.n))])
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40)) / float(1 << 40)
    # about 4 * DOCUMENTS rows of each language, however frequent it is
    drawn = rows.withColumn("h", draw).where(F.col("h") < F.try_element_at(rate, F.col("lang")))
    part = drawn.select("lang", "h", F.substring(F.regexp_replace("text", r"[^\p{L}\p{M}]+", " "), 1, EXCERPT).alias("text"))
    kept = part.groupBy("lang").agg(F.slice(F.sort_array(F.collect_set(F.struct("h", "text"))), 1, DOCUMENTS).alias("x"))
    texts, most = {}, min(CHARACTERS, TOTAL // len(total))
    # what is collected is bounded by TOTAL, however many languages there are; letters() may shorten a text, so twice as much is taken
    joined = kept.select("lang", F.substring(F.array_join("x.text", " "), 1, 2 * most).alias("text"))
    for r in sorted(joined.collect(), key=lambda r: r.lang):
        text = letters(r.text)[:most].decode("utf-8", "ignore")  # not inside a character
        if clean := letters(text):
            texts[r.lang] = clean
    return Model(texts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for each row of docs.

    Null texts and texts without a letter (digits and signs such as ² or Ⅷ are none) are UNKNOWN with score 0. Whole texts
    are read, whatever their length; rows are read one by one, so repeated rows and null ids don't matter;
    equal languages go by name.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for f in frames:
            found = m.predict(list(f["text"]))
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred and score; held-out documents aren't learned from."""
    docs = common.table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    return predict(docs, train(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
