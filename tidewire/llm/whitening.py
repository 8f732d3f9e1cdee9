"""Whitening of embeddings by merged moments.

1. Every partition computes the count, the mean and the centred scatter of its rows, batch by batch, and
   merges the batches by Chan's formula: with d the difference of the means, scatter = A + B + d d' * na * nb / (na + nb).
2. The partitions' moments meet pair by pair in a `treeReduce` with the same formula, so no task and not the
   driver holds more than a few d x d matrices. Sums are kept as integers beside the means, and are exact.
3. `eigh` of the covariance (d x d) on the driver gives the components.
4. A second pass whitens every row and takes the moments of the result the same way: their distance from the
   identity is reported with every row.

Entries are quantised first: x = floor(1024 * c) + 100000. So counts, sums and the squared deviations are exact integers,
and the same on every cluster whatever the order of the merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

STEP, SHIFT = 1024, 100_000
#: Entries beyond this, quantised, have no exact double; their rows are dropped.
LARGEST = 2**53
#: Variances below this share of the largest one count as none.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred scatter of rows; `total` is the exact sum of rows of whole numbers (Python's integers)."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    total: tuple[int, ...] = ()

    @staticmethod
    def of(rows: np.ndarray, exact: bool = False) -> Moments:
        total = tuple(int(hi) * 2**26 + int(lo) for hi, lo in zip((rows >> 26).sum(axis=0), (rows & (2**26 - 1)).sum(axis=0), strict=True)) if exact else ()
        mean = np.array([t / len(rows) for t in total]) if exact else rows.mean(axis=0)
        away = rows - mean
        return Moments(len(rows), mean, away.T @ away, total)

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula."""
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(
            n, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n), tuple(a + b for a, b in zip(self.total, other.total, strict=True))
        )

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def quantised(rows: np.ndarray) -> np.ndarray:
    """x of each entry as a 64-bit integer."""
    return np.floor(STEP * rows).astype(np.int64) + SHIFT


def fitted(df: DataFrame, vector: str, width: int) -> DataFrame:
    """The rows whose vectors count: `width` entries, all finite and small enough to be quantised exactly."""
    small = F.forall(vector, lambda x: F.abs(x.cast("double")) < LARGEST / STEP - SHIFT)
    return df.where(vectors.usable(vector) & (F.size(vector) == width) & small)


def moments(df: DataFrame, vector: str, width: int, whiten: Whitening | None = None) -> Moments | None:
    """Moments of the quantised vectors, or of the whitened ones; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = quantised(vectors.matrix(batch.column(0), width))
            own = Moments.of(whiten.of(x)) if whiten else Moments.of(x, exact=True)
            held = held.merged(own) if held else own
        none = {"n": [0], "mean": [b""], "scatter": [b""], "total": [[]]}
        row = {"n": [held.n], "mean": [held.mean.tobytes()], "scatter": [held.scatter.tobytes()], "total": [[str(t) for t in held.total]]} if held else none
        yield pa.RecordBatch.from_pydict(row, pa.schema([("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary()), ("total", pa.list_(pa.string()))]))

    def read(row) -> Moments | None:
        if not row.n:  # a partition without rows
            return None
        mean = np.frombuffer(row.mean)
        return Moments(row.n, mean, np.frombuffer(row.scatter).reshape(len(mean), len(mean)), tuple(map(int, row.total)))

    parts = df.select(vector).mapInArrow(run, "n long, mean binary, scatter binary, total array<string>").rdd.map(read)
    if not parts.getNumPartitions():
        return None
    return parts.treeReduce(lambda a, b: a.merged(b) if a and b else a or b, depth=3)


@dataclass(frozen=True)
class Whitening:
    """The fitted transform: count, exact sums, eigenvectors (columns) and eigenvalues by falling variance, and the trace."""

    n: int
    total: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def of(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of quantised rows."""
        # whole and broken part of the mean apart, so that no digit of the difference is lost
        whole = np.array([t // self.n for t in self.total], dtype=np.int64)
        broken = np.array([t % self.n / self.n for t in self.total])
        return ((x - whole) - broken) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - total)^2, exact; None beyond a 64-bit integer."""
        edges = [(int(e), t) for ends in (x.min(axis=0), x.max(axis=0)) for e, t in zip(ends, self.total, strict=True)]
        apart, largest = max(abs(self.n * e - t) for e, t in edges), max(max(abs(self.n * e), abs(t)) for e, t in edges)
        if apart * apart * len(self.total) < 2**63 and largest < 2**63:
            return ((self.n * x - np.array(self.total, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        sums = ((self.n * x.astype(object) - np.array(self.total, dtype=object)) ** 2).sum(axis=1)
        return [s if s < 2**63 else None for s in sums]


def fit(df: DataFrame, vector: str, width: int, components: int) -> Whitening | None:
    """The first components of the vectors' covariance; None without rows."""
    m = moments(df, vector, width)
    if m is None:
        return None
    values, axes = np.linalg.eigh(m.covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > NO_VARIANCE * max(values.max(), 0)]
    return Whitening(m.n, m.total, axes[:, order], values[order], float(np.trace(m.covariance)))


def whitened(df: DataFrame, components: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, holds null or non-finite entries, entries of 2^43 or so and beyond, or another
    number of entries than most (of equally frequent numbers the larger counts), are dropped. Repeated rows and null
    keys count like any others; other columns are ignored. Components without variance (below 1e-12 of the largest)
    have no whitened value and are left out, so equal vectors, or a single one, give no row, as an empty table does. Equal
    eigenvalues leave the choice of axes open. deviation is null where it exceeds 64 bits."""
    common.small_batches(df.sparkSession)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(key, vector)
    width = vectors.common_width(rows, vector)
    rows = fitted(rows, vector, width)
    model = fit(rows, vector, width, components) if width else None
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    error = float(np.abs(moments(rows, vector, width, model).covariance - np.eye(len(model.values))).max())
    return rows.mapInArrow(partial(_rows, model=model, width=width, error=error, names=[key, *COLUMNS]), schema)


COLUMNS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def _rows(batches: Iterator[pa.RecordBatch], model: Whitening, width: int, error: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = quantised(vectors.matrix(batch.column(1), width))
        again = lambda values: pa.array(np.tile(values, batch.num_rows))  # noqa: E731, B023
        taken = pa.array(np.repeat(np.arange(batch.num_rows), k))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(taken), again(np.arange(1, k + 1, dtype=np.int32)), again(np.int64(model.n).repeat(k)), pa.array(model.deviation(x), pa.int64()).take(taken),
                pa.array(model.of(x).ravel()), again(model.values / model.trace), again(np.float64(error).repeat(k)),
            ],
            names,
        )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened coordinates of all embeddings."""
    return whitened(common.table(spark, sf_dir, "embeddings"))
