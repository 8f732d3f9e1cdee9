"""Packing documents into training sequences by vector bin packing.

Every piece has three demands: tokens, segments (one each) and loss-bearing tokens. Every sequence has
the three capacities of `Limits`. Sequences are filled one at a time by the dot-product heuristic: of the
waiting pieces that still fit, the one whose scaled demands have the largest dot product with the
sequence's scaled remaining capacities comes next, until none fits.

A document longer than a sequence is cut into full sequences and a rest; rests and short documents are
packed whole. Pieces wait in a pool of bounded size, from which sequences are filled whenever it holds
`Limits.pool` tokens more than the `Limits.choice` tokens kept back to choose from.

No shuffle is needed: a scan partition packs its own documents, and a sequence's id is made of the
partition's number and a counter within it. The scan's splits and the order within them are fixed, so a
task that runs again after a lost executor gives the same sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence: tokens, segments, loss-bearing tokens (None: as many as tokens)."""

    tokens: int = 4096
    segments: int = 128
    loss_tokens: int | None = None
    #: Tokens of waiting pieces at which sequences are filled, and those kept back for a good choice.
    pool: int = 1_000_000
    choice: int = 250_000

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.tokens if self.loss_tokens is None else self.loss_tokens], dtype=np.float64)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class Packer:
    """Fills sequences from a pool of pieces (item, start, length)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.cap = limits.capacity
        self.pieces: list[tuple[int, int, int]] = []
        self.needs: list[tuple[int, int, int]] = []
        self.waiting = 0

    def add(self, item: int, tokens: int, loss: np.ndarray | None = None) -> None:
        """loss: positions of the loss-bearing tokens in order; None: all."""
        start = 0
        while start < tokens:
            length = self._cut(tokens - start, loss, start)
            bearing = length if loss is None else int(np.searchsorted(loss, start + length) - np.searchsorted(loss, start))
            self.put((item, start, length), (length, 1, bearing))
            start += length

    def put(self, piece: tuple[int, int, int], need: tuple[int, int, int]) -> None:
        self.pieces.append(piece)
        self.needs.append(need)
        self.waiting += need[0]

    def full(self) -> bool:
        return self.waiting >= self.limits.pool + self.limits.choice

    def fill(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences filled from the pool, until `choice` tokens are left or, at last, nothing."""
        if not self.pieces:
            return
        needs = np.array(self.needs, dtype=np.float64)
        order = np.lexsort((np.arange(len(needs)), -(needs / np.where(self.cap > 0, self.cap, 1)).max(axis=1)))
        needs, pieces = needs[order], [self.pieces[i] for i in order]
        scale = np.where(self.cap > 0, self.cap, 1)
        # by capacity, so that each test is one pass over a plain vector
        need, share = needs.T.copy(), (needs / scale).T.copy()
        left, waits = np.arange(len(needs)), np.ones(len(needs), dtype=bool)
        while len(left) and (last or self.waiting > self.limits.choice):
            free, bin_ = self.cap.copy(), []
            fits = left
            while len(fits):
                now = free / scale
                best = fits[int(np.argmax(sum(w * s[fits] for w, s in zip(now, share, strict=True))))]
                bin_.append(best)
                waits[best] = False
                free -= needs[best]
                for f, n in zip(free, need, strict=True):
                    fits = fits[n[fits] <= f]
                fits = fits[waits[fits]]
            self.waiting -= int(needs[bin_, 0].sum())
            left = left[waits[left]]
            yield [pieces[i] for i in bin_]
        self.pieces, self.needs = [pieces[i] for i in left], [tuple(map(int, needs[i])) for i in left]

    def _cut(self, rest: int, loss: np.ndarray | None, start: int) -> int:
        """The longest piece from start on that an empty sequence can hold."""
        length = min(rest, int(self.cap[0]), int(self.cap[2]) if loss is None else rest)
        if loss is not None:
            first = int(np.searchsorted(loss, start))
            if first + int(self.cap[2]) < len(loss):
                length = min(length, int(loss[first + int(self.cap[2])]) - start)
        if length < 1 or self.cap[1] < 1:
            raise ValueError("the limits leave no room for a single token")
        return length


class WordTokens:
    """Token ids of whole texts by a `tokenizers` file, with a cache of words.

    Exact for tokenizers that split at ASCII white space and drop it: a text's ids are then those of its
    words, one after another. Words new to the cache are encoded by the tokenizer itself. A text that
    holds the string of a special token is encoded as a whole.
    """

    #: Words kept; new ones are learned in some 9 microseconds each, so most of what a task learns should serve the next.
    BOUND = 1_200_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [v for k, v in self.tokenizer.get_vocab().items() if k.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.is_end[ends] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        # for these characters lower() and the pattern below do what the file's normalizer and splitter do
        self.safe = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        safe = [bool(self.safe.fullmatch(t)) for t in texts]
        words = [t.lower().split() if ok else [] for t, ok in zip(texts, safe, strict=True)]
        if len(self.words) > self.BOUND:
            self.words.clear()
        if new := set().union(*words).difference(self.words):
            self._learn_words(new)
        get = self.words.__getitem__
        return [self._special(t) or (b"".join(map(get, ws)) if ok else self._odd(t)) for t, ok, ws in zip(texts, safe, words, strict=True)]

    def _special(self, text: str) -> bytes | None:
        return self._plain([text])[0] if "<|" in text and any(s in text for s in self.special) else None

    def _odd(self, text: str) -> bytes:
        """A text with characters beyond the safe ones: its other words are encoded one by one."""
        out = []
        for w in re.split(r"[ \t\n\r\f\v]+", text):
            if self.safe.fullmatch(w):
                w = w.lower()
                if w not in self.words:
                    self._learn_words({w})
                out.append(self.words[w])
            else:
                out.append(self._plain([w])[0])
        return b"".join(out)

    def _learn_words(self, new: set[str]) -> None:
        """Words of letters only are one part; the others' parts are words of their own, kept along with them."""
        plain = set(filter(str.isalpha, new))
        split = {w: self.split.findall(w) for w in new - plain}
        self._learn(list(plain.union(*split.values()).difference(self.words)))
        get = self.words.__getitem__
        self.words.update([(w, b"".join(map(get, ps))) for w, ps in split.items() if len(ps) != 1])

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        for k in range(0, len(new), 2000):
            some = new[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.is_end[ids]) + 1
            if len(cuts) == len(some):  # each part ends with an id that ends a word
                raw, start = ids.tobytes(), 0
                for p, end in zip(some, (4 * cuts).tolist(), strict=True):
                    self.words[p] = raw[start:end]
                    start = end
            else:
                self.words.update(zip(some, self._plain(some), strict=True))


_encoders: dict[str, WordTokens] = {}


def encoder(path: str) -> WordTokens:
    """One tokenizer for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordTokens(path)
    return _encoders[path]


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 2, with_ids: bool = True, loss_from: Callable[[str], int] | None = None) -> DataFrame:
    """Sequences of at most limits.tokens ids, as rows of pieces (SCHEMA).

    docs: doc_id and text, other columns are ignored. A null text counts as empty; an empty text still
    has its end id. A null doc_id stays null. Repeated rows are packed as often as they occur. Texts of
    any length are packed whole. tokenizer: a file of the `tokenizers` library that every executor has.
    loss_from: number of a text's leading ids without loss (a prompt); none if it isn't given.
    with_ids: whether `ids` holds the piece's ids (little-endian unsigned 32 bits) or is null.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack_partition(batches, tokenizer, limits, end_id, with_ids, loss_from)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _pack_partition(batches, tokenizer, limits, end_id, with_ids, loss_from) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 32
    enc, packer, end = encoder(tokenizer), Packer(limits), np.array([end_id], dtype="<u4").tobytes()
    kept: dict[int, tuple[int, bytes]] = {}  # documents with pieces in open sequences
    at = 0

    def rows(sequences: Iterator[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        cols: dict[str, list] = {f.name: [] for f in SCHEMA}
        for pieces in sequences:
            offset = 0
            for k, start, length in pieces:
                doc, ids, loss = kept[k]
                part = ids[4 * start : 4 * (start + length)]
                bearing = length if loss is None else int(np.searchsorted(loss, start + length) - np.searchsorted(loss, start))
                for c, v in zip(cols.values(), (doc, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, bearing, part if with_ids else None), strict=True):
                    c.append(v)
                offset += length
            sequence += 1
        yield pa.RecordBatch.from_pydict(cols, schema=ARROW)

    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        step = 64  # texts encoded at once
        for k in range(0, len(texts), step):
            for doc, ids, text in zip(docs[k : k + step], enc.encode(texts[k : k + step]), texts[k : k + step], strict=True):
                ids += end
                n = len(ids) // 4
                loss = None if loss_from is None else np.arange(min(loss_from(text), n), n)
                kept[at] = (doc, ids, loss)
                packer.add(at, n, loss)
                at += 1
            if packer.full():
                yield from rows(packer.fill(False))
                needed = {k for k, _, _ in packer.pieces}
                kept = {k: v for k, v in kept.items() if k in needed}
    yield from rows(packer.fill(True))


ARROW = pa.schema([(f.name, pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64()) for f in SCHEMA])


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Place whole examples given by their sizes (id, tokens, loss_tokens): (id, sequence_id, slot).

    An example that alone exceeds a limit can't be placed whole and gets a null sequence. Null sizes
    count as 0. Every example takes one segment.
    """
    common.small_batches(examples.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        packer = Packer(limits)
        ids: dict[int, int] = {}
        at = 0

        def out(bins):
            nonlocal sequence
            rows = []
            for pieces in bins:
                rows += [(ids.pop(k), sequence, slot) for slot, (k, _, _) in enumerate(pieces)]
                sequence += 1
            return pd.DataFrame(rows, columns=["id", "sequence_id", "slot"]).astype({"sequence_id": "Int64", "slot": "Int64"})

        for frame in frames:
            need = np.stack([frame["tokens"].fillna(0), np.ones(len(frame)), frame["loss_tokens"].fillna(0)], axis=1).astype(float)
            bad = (need > packer.cap).any(axis=1)
            yield pd.DataFrame({"id": frame["id"][bad], "sequence_id": pd.array([pd.NA] * int(bad.sum()), dtype="Int64"), "slot": pd.array([pd.NA] * int(bad.sum()), dtype="Int64")})
            for i in np.flatnonzero(~bad):
                ids[at] = frame["id"].iloc[i]
                packer.put((at, 0, int(need[i, 0])), tuple(map(int, need[i])))
                at += 1
                if packer.full():
                    yield out(packer.fill(False))
        yield out(packer.fill(True))

    return examples.select("id", "tokens", "loss_tokens").mapInPandas(run, "id long, sequence_id long, slot long")


def default_tokenizer() -> str:
    """The 49k word vocabulary of the public tokenizers; executors find it under the same path."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens: a row for each piece."""
    return pack(common.table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False).drop("ids")
