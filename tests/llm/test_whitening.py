"""Whitening against numpy, and its edge cases."""

import math

import numpy as np
import pytest

from tidewire.llm import common, whitening


def plain(rows):
    """The contract's figures by whole matrices; rows: (id, list of numbers)."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, total = len(rows), x.sum(axis=0)
    deviation = [int(((n * r - total) ** 2).sum()) for r in x]
    centred = (n * x - total).astype(np.float64) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e)[:8]
    return n, deviation, centred @ axes[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def check(rows, out):
    n, deviation, white, explained = plain(rows)
    place, k = {id_: i for i, (id_, _) in enumerate(rows)}, white.shape[1]
    assert len(out) == n * k
    got = np.zeros_like(white)
    for r in out:
        assert r.n == n and r.deviation == deviation[place[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        got[place[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-9
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9
    assert len({r.identity_error for r in out}) == 1


def test_query_equals_whole_matrices(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in common.table(spark, sf, "embeddings").collect()]
    check(rows, whitening.op12_embedding_whitening(spark, sf).collect())


def test_moments_merge_like_whole_rows():
    rng = np.random.default_rng(1)
    x = whitening.quantised(rng.normal(50, 3, (700, 5)) * [1, 10, 100, 1e-3, 1e6])
    parts = [whitening.Moments.of(p, exact=True) for p in np.split(x, [1, 2, 90, 91, 400])]
    m, whole = parts[0], whitening.Moments.of(x, exact=True)
    for p in parts[1:]:
        m = m.merged(p)
    assert m.n == 700 and m.total == whole.total == tuple(x.sum(axis=0).tolist())
    assert np.allclose(m.mean, whole.mean, rtol=1e-14) and np.allclose(m.scatter, whole.scatter, rtol=1e-10)


SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string"


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    good = [(k, [math.sin(k * 1.7), math.cos(k * k), k % 3 - 1.0]) for k in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, nan, 2.0]), (104, [1.0, -inf, 0.0]), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    d = spark.createDataFrame([(k, v, 1, 7, "x") for k, v in good + odd], SCHEMA).repartition(5)
    check(good, whitening.whitened(d).collect())
    assert whitening.whitened(d.where("vec_id >= 100 AND vec_id <> 105")).count() == 0
    assert whitening.whitened(d.where("FALSE")).count() == 0 and whitening.whitened(d.where("vec_id = 3")).count() == 0
    twice = whitening.whitened(d.union(d)).collect()
    assert len(twice) == 2 * 3 * len(good) and {r.n for r in twice} == {80}
    keyless = spark.createDataFrame([(None, [float(k), k * k / 7.0]) for k in range(9)], "vec_id long, embedding array<double>")
    out = whitening.whitened(keyless).collect()
    assert len(out) == 18 and {r.vec_id for r in out} == {None}
    flat = spark.createDataFrame([(k, [float(k), 5.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}  # no variance in the second dimension
    far = spark.createDataFrame([(k, [(-1.0) ** k * 4e12, k / 3.0]) for k in range(6)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitened(far).collect()} == {None}
    large = spark.createDataFrame([(k, [8e12 - 1e6, k / 3.0]) for k in range(3000)], "vec_id long, embedding array<double>")  # sums beyond 64 bits
    assert {r.deviation for r in whitening.whitened(large).where("vec_id = 1").collect()} == {((1024 // 3 + 100_000) * 3000 - sum(int(1024 * (k / 3.0)) + 100_000 for k in range(3000))) ** 2}
