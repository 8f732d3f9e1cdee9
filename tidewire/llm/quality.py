"""Document quality: random Fourier features, ridge regression by partition sums, isotonic calibration.

Standardised document statistics go through random Fourier features, whose inner products approximate a
Gaussian kernel. Every partition of the training sample adds up its normal equations, apart for each
fold; the driver adds the partitions' sums and solves for ridge weights. Scores of held-back folds (their
sums taken out of the whole) are calibrated by isotonic regression, interpolated between its steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, docstats

#: Bound of the training sample (labelled documents, chosen by a hash of doc_id), features, folds, ridge.
SAMPLE, FEATURES, FOLDS, RIDGE, WIDTH = 20_000, 192, 4, 1.0, 0.35
PREDICT_FROM = 0.3


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    seed: int = 7

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale, self.seed)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.fourier(stats) @ self.weights
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int) -> np.ndarray:
    """sqrt(2/D) cos(xW + b), and a constant column."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, WIDTH, (len(mean), FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.cos(x @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing function of the score that fits y best: pool adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, t = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + m * n) / (a[1] + n), a[1] + n, a[2] + t]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def sample_stats(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, y and the statistics of at most `sample` labelled documents, equal rows once.

    Of several labels of a doc_id the smallest counts; null labels, ids and texts are left out."""
    common.small_batches(docs.sparkSession)
    chosen = labels.where(f"{label} IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(label).cast("long").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so the broadcast is bounded
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame(docstats.statistics(list(f["text"]))[1], columns=docstats.NAMES)
            yield pd.concat([f[["doc_id", "copy", "y"]].reset_index(drop=True), out], axis=1)

    stats = ", ".join(f"{c} double" for c in docstats.NAMES)
    found = texts.withColumn("copy", F.xxhash64("text")).mapInPandas(run, f"doc_id long, copy long, y long, {stats}").dropDuplicates(["doc_id", "copy"])
    # a doc_id may stand for many texts, so the bound holds for the rows themselves
    return common.materialize(found.orderBy(F.xxhash64("doc_id", "copy"), "doc_id", "copy").limit(sample).drop("copy"), f"{label}-sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """None if there is nothing to learn from: no labelled document or no statistics that vary."""
    rows = sample_stats(docs, labels, "quality", sample)
    moments = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{p}{c}") for c in docstats.NAMES for f, p in ((F.avg, "m_"), (F.stddev_pop, "s_"))]).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m_{c}"] for c in docstats.NAMES])
    scale = np.maximum(np.array([moments[f"s_{c}"] for c in docstats.NAMES]), 1e-6)
    size, seed = FEATURES + 1, Model.seed

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, moment = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for f in frames:
            z, fold = fourier(f[list(docstats.NAMES)].to_numpy(), mean, scale, seed), f["doc_id"].to_numpy() % FOLDS
            for k in range(FOLDS):
                own = fold == k
                gram[k] += z[own].T @ z[own]
                moment[k] += z[own].T @ f["y"].to_numpy()[own]
        yield pd.DataFrame({"fold": range(FOLDS), "gram": [g.tobytes() for g in gram], "moment": [m.tobytes() for m in moment]})

    gram, moment = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in rows.coalesce(8).mapInPandas(sums, "fold int, gram binary, moment binary").collect():  # 8 * FOLDS rows at most
        gram[r.fold] += np.frombuffer(r.gram).reshape(size, size)
        moment[r.fold] += np.frombuffer(r.moment)
    solve = lambda g, m: np.linalg.solve(g + np.diag([RIDGE] * FEATURES + [1e-6]), m)
    whole = solve(gram.sum(axis=0), moment.sum(axis=0))
    held = [solve(gram.sum(axis=0) - gram[k], moment.sum(axis=0) - moment[k]) for k in range(FOLDS)]
    back = rows.toPandas().sort_values("doc_id")  # `sample` rows at most
    z, fold = fourier(back[list(docstats.NAMES)].to_numpy(), mean, scale, seed), back["doc_id"].to_numpy() % FOLDS
    score = np.einsum("ij,ij->i", z, np.stack(held)[fold])
    return Model(mean, scale, whole, isotonic(score, back["y"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: good quality likelier) for each row of docs.

    Null and empty texts are scored by the statistics of an empty text; texts of any length are read
    whole; rows are scored one by one, whatever their ids. Without a model every score is 0.5.
    """
    common.small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = model.score(docstats.statistics(list(f["text"]))[1]) if model else np.full(len(f), 0.5)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "score": s})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score and predicted; held-out labels aren't learned from."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
