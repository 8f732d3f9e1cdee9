"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another. The model of a category sees word features and the
probabilities of all earlier categories; it is trained with out-of-fold predictions of those, so that it
learns from probabilities as good as they are at scoring time.

Features: counts (log1p) of the words, and apart from them of the word beginnings of 5 to 7 letters, that
tell toxic from other training documents best, by the z-score of their log odds, found in the training
sample itself. Each kind has a list of its own, so that neither takes the other's places: beginnings find
the stems of languages with many inflected forms, each too rare to be a feature. Languages written without
spaces have only whole runs of letters and their beginnings.

The labels have one flag; the two categories before it are derived for flagged training documents: `insulting`
(at least one word that points to toxicity by itself or by its beginning) and `abusive` (at least three
such occurrences). Which words point there is found in the other folds only, never in the document's own, and the models
of these categories don't see their count: they have to find them in single features. The last model, whose category is
the flag itself, does. Out-of-fold predictions come from features that were chosen, and models that were fitted,
without the fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bounds of the training sample (labelled documents, chosen by a hash of doc_id) and of the features of each kind.
SAMPLE, FEATURES = 12_000, 192
#: z-score from which a feature points to toxicity, and documents it must occur in.
POINTING_Z, MIN_DOCS = 5.0, 5
#: Letters of the word beginnings.
PREFIXES = (5, 6, 7)
#: Words and beginnings of documents handed over at once; all are, this bounds a worker's memory only.
FORM_ROWS = 20_000
CATEGORIES = ("insulting", "abusive", "toxic")
FOLDS = 5
#: Bounds of the probability from which a document is toxic; within them it is where out-of-fold predictions have the best F1.
THRESHOLDS = (0.3, 0.7)

_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def word(raw: str) -> str:
    """A white-space word in lower case without what isn't a letter around it."""
    return _EDGES.sub("", raw).lower()


def forms(w: str) -> list[str]:
    """A word's features: itself and its beginnings, marked by a star (no word ends in one)."""
    return [w, *(w[:k] + "*" for k in PREFIXES if len(w) >= k)] if w else []


class _Index(dict):
    """Number of the set of features that each white-space word has, -1 if it has none."""

    BOUND = 500_000

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.number = {w: k for k, w in enumerate(vocabulary)}
        self.sets: dict[tuple[int, ...], int] = {}

    def __missing__(self, raw: str) -> int:
        if len(self) > self.BOUND:
            self.clear()
        own = tuple(self.number[f] for f in forms(word(raw)) if f in self.number)
        n = self[raw] = self.sets.setdefault(own, len(self.sets)) if own else -1
        return n

    def members(self, pointing: np.ndarray | None = None) -> np.ndarray:
        """For each set its features; with pointing (a column for each fold) also in which folds one of them points to toxicity."""
        out = np.zeros((len(self.sets), len(self.number) + (0 if pointing is None else pointing.shape[1])))
        for own, k in self.sets.items():
            out[k, list(own)] = 1
            if pointing is not None:
                out[k, len(self.number) :] = pointing[list(own)].any(axis=0)
        return out


def counts(texts: list[str | None], index: _Index, pointing: np.ndarray | None = None) -> np.ndarray:
    """Occurrences of each feature in each text, and with pointing last, for each fold, those of words that point to toxicity."""
    found = []
    for t in texts:
        words = (t or "").split()
        n = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        found.append(np.bincount(n[n >= 0]))
    sets = np.zeros((len(texts), len(index.sets)))
    for k, n in enumerate(found):
        sets[k, : len(n)] = n
    return sets @ index.members(pointing)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (the intercept last) of an L2-penalised logistic model, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """Linear models of categories in order; each takes the features and the earlier probabilities, the last one also
    features of its own."""

    weights: list[np.ndarray]
    held: np.ndarray | None = None  # the out-of-fold predictions

    def __getstate__(self):  # they stay on the driver
        return {"weights": self.weights, "held": None}

    @classmethod
    def fit(cls, x: np.ndarray | Sparse, y: np.ndarray, fold: np.ndarray, use: np.ndarray | None = None, fold_use: dict[int, np.ndarray] | None = None, last: np.ndarray | None = None, penalty: float = 1.0) -> Chain:
        """x: features; y: a column for each category; fold: a number for each row. use: the columns of x of the final models;
        fold_use: for each fold the columns that were chosen without it. All by default. last: columns for the last category only."""
        whole = x if use is None else x[:, use]
        weights, before = [], np.zeros((len(x), 0))
        for j in range(y.shape[1]):
            more = [before] if last is None or j < y.shape[1] - 1 else [before, last]
            weights.append(fit_logistic(np.hstack([whole, *more]), y[:, j], penalty))
            held = np.zeros(len(x))
            for k in np.unique(fold).tolist():
                own, z = fold == k, np.hstack([x if fold_use is None else x[:, fold_use[k]], *more])
                # with a single fold there are no others to learn from
                held[own] = probability(z[own], fit_logistic(z[~own], y[~own, j], penalty)) if (~own).any() else y[:, j].mean()
            before = np.hstack([before, held[:, None]])
        return cls(weights, before)

    def predict(self, x: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        out = []
        for w in self.weights:
            if last is not None and len(out) == len(self.weights) - 1:
                x = np.hstack([x, last])
            out.append(probability(x, w))
            x = np.hstack([x, out[-1][:, None]])
        return np.stack(out, axis=1)


@dataclass
class Model:
    vocabulary: list[str]
    pointing: np.ndarray  # whether each feature points to toxicity, as a column
    chain: Chain | None  # None: nothing to learn from
    threshold: float = 0.5

    def score(self, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n)
        return self.chain.predict(x[:, :-1], x[:, -1:]) if self.chain else np.zeros((len(n), len(CATEGORIES)))


class Sparse:
    """A matrix of few values by rows; x[:, columns] is dense. Rows are pairs of bytes: column numbers and values."""

    def __init__(self, rows: list[tuple[bytes, bytes]], width: int):
        self.rows, self.width = [(np.frombuffer(at, dtype="<u2"), np.frombuffer(v, dtype="<f4")) for at, v in rows], width

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, key: tuple[slice, np.ndarray]) -> np.ndarray:
        place = np.full(self.width, len(key[1]))
        place[key[1]] = np.arange(len(key[1]))
        out = np.zeros((len(self.rows), len(key[1]) + 1), dtype=np.float32)  # the last column takes what isn't asked for
        for row, (at, v) in zip(out, self.rows, strict=True):
            row[place[at]] = v
        return out[:, :-1]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1, the one nearest to 0.5 among equals, on a grid of hundredths."""
    grid = np.arange(round(100 * THRESHOLDS[0]), round(100 * THRESHOLDS[1]) + 1) / 100
    hit = np.array([(y & (p >= t)).sum() for t in grid])
    f1 = np.round(2 * hit / (np.array([(p >= t).sum() for t in grid]) + max(1, y.sum())), 9)
    return float(min(zip(-f1, np.abs(grid - 0.5), grid, strict=True))[2])


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, flag and text of at most `sample` documents, one for each text; of several labels the highest counts."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("flag"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so the broadcast is bounded
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("copy", F.xxhash64("text"))
    once = texts.groupBy("copy").agg(F.min(F.struct("doc_id", "flag", "text")).alias("x")).select("x.*")
    # a doc_id may stand for many texts, so the bound holds for the rows themselves
    return common.materialize(once.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(sample).repartition(32, "doc_id"), "toxicity-sample")


def _z(b, n, bad: int, good: int):
    """z-score of the log odds of a word in b of bad and n - b of good documents."""
    b, g = b + 0.5, n - b + 0.5
    return (F.log(b / (bad + 1 - b)) - F.log(g / (good + 1 - g))) / F.sqrt(1 / b + 1 / g)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit the chain on at most `sample` labelled documents. Rows without a label or text teach nothing;
    of a doc_id's several labels the highest counts; equal texts count once."""
    common.small_batches(docs.sparkSession)
    texts = labelled(docs, labels, sample)

    def distinct_forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t, y, k in zip(f["text"], f["flag"], f["doc_id"] % FOLDS, strict=True):
                rows += [(w, int(y > 0), int(k)) for w in {x for r in set(t.split()) for x in forms(word(r))}]
                if len(rows) > FORM_ROWS:
                    yield pd.DataFrame(rows, columns=["word", "flag", "fold"])
                    rows = []
            yield pd.DataFrame(rows, columns=["word", "flag", "fold"])

    bad, good = np.zeros(FOLDS, np.int64), np.zeros(FOLDS, np.int64)
    for fold, flag, n in texts.groupBy(F.pmod("doc_id", F.lit(FOLDS)).alias("fold"), (F.col("flag") > 0).alias("flag")).count().collect():
        (bad if flag else good)[fold] += n
    if not bad.sum() or not good.sum():
        return Model([], np.zeros((0, 1), bool), None)
    here = lambda v, k: F.sum(F.when(F.col("fold") == k, v).otherwise(0))
    df = texts.mapInPandas(distinct_forms, "word string, flag long, fold int").groupBy("word").agg(
        F.sum("flag").alias("b"), F.count("*").alias("n"), *[here(F.col("flag"), k).alias(f"b{k}") for k in range(FOLDS)], *[here(F.lit(1), k).alias(f"n{k}") for k in range(FOLDS)]
    )
    df = df.where(F.col("n") >= MIN_DOCS).withColumn("kind", F.col("word").endswith("*"))
    parts = {FOLDS: (F.col("b"), F.col("n"), int(bad.sum()), int(good.sum()))}  # FOLDS: all folds; k: all but fold k
    parts |= {k: (F.col("b") - F.col(f"b{k}"), F.col("n") - F.col(f"n{k}"), int(bad.sum() - bad[k]), int(good.sum() - good[k])) for k in range(FOLDS)}
    df = df.select("word", "kind", *[_z(*p).alias(f"z{k}") for k, p in parts.items()])
    df = df.withColumns({f"r{k}": F.row_number().over(Window.partitionBy("kind").orderBy(F.abs(f"z{k}").desc(), "word")) for k in parts})
    found = df.where(F.least(*[F.col(f"r{k}") for k in parts]) <= features).orderBy("word").toPandas()  # 2 * (FOLDS + 1) * features rows at most
    vocabulary = found["word"].tolist()
    used = {k: np.flatnonzero(found[f"r{k}"].to_numpy() <= features) for k in parts}
    pointing = np.stack([(found[f"z{k}"] >= POINTING_Z).to_numpy(bool) for k in parts], axis=1)  # first that of all folds

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(vocabulary)
        for f in frames:
            n = counts(list(f["text"]), index, pointing)
            fold = f["doc_id"].to_numpy() % FOLDS
            words, at = np.log1p(n[:, : len(vocabulary)]).astype("<f4"), [np.flatnonzero(r) for r in n[:, : len(vocabulary)]]
            toward = n[np.arange(len(f)), len(vocabulary) + 1 + fold]  # by words found in the other folds
            yield pd.DataFrame({"doc_id": f["doc_id"], "flag": f["flag"], "toward": toward, "at": [a.astype("<u2").tobytes() for a in at], "x": [r[a].tobytes() for r, a in zip(words, at, strict=True)]})

    rows = texts.mapInPandas(count, "doc_id long, flag int, toward double, at binary, x binary").toPandas().sort_values(["doc_id", "at", "x"])  # `sample` rows at most
    flag, fold, toward = rows["flag"].to_numpy() > 0, rows["doc_id"].to_numpy() % FOLDS, rows["toward"].to_numpy()
    x = Sparse(list(zip(rows.pop("at"), rows.pop("x"), strict=True)), len(vocabulary))
    y = np.stack([flag & (toward >= 1), flag & (toward >= 3), flag], axis=1).astype(np.float64)
    chain = Chain.fit(x, y, fold, used[FOLDS], used, np.log1p(toward[:, None]))
    return Model([vocabulary[i] for i in used[FOLDS]], pointing[used[FOLDS], :1], chain, best_threshold(chain.held[:, -1], flag))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, copy (hash of the text), a probability for each category, and toxic.

    Null and empty texts get the scores of a text without any of the features. Texts of any length are read
    whole. Every row is scored by itself, so repeated rows and null doc_ids don't matter.
    """
    common.small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(model.vocabulary)
        for f in frames:
            p = model.score(counts(list(f["text"]), index, model.pointing))
            out = pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "copy": f["copy"].astype("Int64")})
            for j, c in enumerate(CATEGORIES):
                out[f"p_{c}"] = p[:, j]
            out["toxic"] = p[:, -1] >= model.threshold
            yield out

    schema = "doc_id long, copy long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text").mapInPandas(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that aren't rejected."""
    return common.without(docs, score(docs, train(docs, labels)).where("toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the chain's probabilities, toxic and kept (not toxic)."""
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, train(docs, common.table(spark, sf_dir, "labels"))).drop("copy")
    return out.withColumn("kept", ~F.col("toxic"))
