"""Quality rules: fixed rules, then gradient-boosted trees over document statistics.

The trees are fitted on histograms of a bounded sample, with monotonic constraints on chosen statistics,
and flattened into numpy arrays of nodes, so that a batch of documents goes through all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, docstats
from .quality import sample_stats

#: Bound of the training sample, and the shape of the ensemble.
SAMPLE, TREES, DEPTH, RATE, BINS, LEAST = 20_000, 60, 3, 0.15, 32, 20
#: Statistics in which a document can only get worse (-1) or better (1).
MONOTONE = {"symbols": -1, "symbol_words": -1, "mark_words": -1, "marks": -1, "bars": -1, "dup_lines": -1, "repeat_words": -1, "top_word": -1}
#: Documents less likely than this to be good fail.
KEEP_FROM = 0.5


@dataclass
class Trees:
    """Nodes of all trees in one array each: children are node numbers, a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, penalty: float = 1.0) -> Trees:
    """Logistic boosting with second-order gains. monotone: -1, 0 or 1 for each column."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    f = np.full(n, base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(0)
        cut.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    def grow(own: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, levels: int) -> int:
        gs, hs = g[own].sum(), h[own].sum()
        weight = lambda a, b: float(np.clip(-a / (b + penalty), low, high))
        best, where = 1e-6, None
        if levels and len(own) >= 2 * LEAST:
            for j in range(width):
                if not len(cuts[j]):
                    continue
                b = binned[own, j]
                size = len(cuts[j]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g[own], h[own], np.ones(len(own))))
                wl, wr = np.clip(-gl / (hl + penalty), low, high), np.clip(-(gs - gl) / (hs - hl + penalty), low, high)
                loss = lambda w, a, c: -(a * w + 0.5 * (c + penalty) * w * w)
                gain = loss(wl, gl, hl) + loss(wr, gs - gl, hs - hl) - loss(weight(gs, hs), gs, hs)
                gain[(nl < LEAST) | (len(own) - nl < LEAST) | (monotone[j] * (wr - wl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, where = gain[k], (j, k, float(wl[k]), float(wr[k]))
        if where is None:
            v = rate * weight(gs, hs)
            f[own] += v
            return leaf(v)
        j, k, wl, wr = where
        me = leaf(0.0)
        feature[me], cut[me] = j, cuts[j][k]
        mid = (wl + wr) / 2
        bounds = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid)) if monotone[j] < 0 else ((low, high),) * 2
        goes = binned[own, j] <= k
        left[me] = grow(own[goes], g, h, *bounds[0], levels - 1)
        right[me] = grow(own[~goes], g, h, *bounds[1], levels - 1)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), -8.0, 8.0, depth))
    return Trees(*(np.array(a) for a in (roots, feature, cut, left, right, value)), depth, base)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """None if there are no labelled documents of both kinds."""
    rows = sample_stats(docs, labels, "quality", sample).toPandas().sort_values("doc_id")  # `sample` rows at most
    y = rows["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(rows[list(docstats.NAMES)].to_numpy(), y, np.array([MONOTONE.get(c, 0) for c in docstats.NAMES]))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def apply_rules(docs: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, the fixed rules' verdict, the trees' score and whether each row of docs is kept.

    Null and empty texts have no words and so fail. Texts of any length are read whole; rows are judged
    one by one, whatever their ids. Without trees the fixed rules decide alone and scores are null.
    """
    common.small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counts, stats = docstats.statistics(list(f["text"]))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            p = trees.predict(stats) if trees else np.full(len(f), np.nan)
            out = pd.DataFrame(counts, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").to_numpy())
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), base_failed=failed, score=pd.array(p, dtype="Float64") if trees else None, kept=~failed & ((p >= keep_from) if trees else True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdicts."""
    docs = common.table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, common.table(spark, sf_dir, "labels")))
