"""The shortcuts inside a near-duplicate bucket give what comparing all pairs gives."""

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import common, neardup


def test_reaches_is_the_estimate_cut():
    rng = np.random.default_rng(0)
    n, m = 50_000, neardup.Sketch().registers
    equal = rng.integers(0, m + 1, n)
    more = (rng.random(n) * (m + 1 - equal)).astype(int)
    a = rng.integers(1, 5000, n).astype(float)
    b = np.maximum(1, np.round(a * rng.uniform(0.5, 2, n)))
    for least in (0.61, 0.66):
        full = neardup.estimate(equal, more, m - equal - more, a, b, 1.001)
        differ = (full >= least) != neardup.reaches(equal, more, m - equal - more, a, b, 1.001, least)
        assert (np.abs(full[differ] - least) < 0.02).all() and differ.mean() < 1e-3


def test_grown_components_equal_those_of_all_pairs():
    rng = np.random.default_rng(1)
    for spread in (1.0, 15.0, 60.0):
        x = rng.random(250) * spread
        calls = []

        def similar(a, b, x=x, calls=calls):
            calls.append(len(a))
            return np.abs(x[a] - x[b]) < 0.2

        a, b = neardup.grown(np.arange(250), similar)
        i, j = np.triu_indices(250, 1)
        hit = np.abs(x[i] - x[j]) < 0.2
        assert (common.local_components(250, a, b) == common.local_components(250, i[hit], j[hit])).all()
    calls.clear()
    neardup.grown(np.arange(250), lambda a, b: calls.append(len(a)) or np.ones(len(a), dtype=bool))
    assert sum(calls) == 249  # a group of copies takes one pass


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    base = [f"word{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: k % 100], f"other{k}", *base[k % 100 + 1 :]])) for k in range(300)]
    rows += [(1000 + k, " ".join(f"own{k}_{i}" for i in range(50))) for k in range(40)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), threshold=85)
    groups = {r.component_id for r in out.where("doc_id < 1000").collect()}
    assert groups == {0} and out.where(F.col("doc_id") >= 1000).where("NOT kept").count() == 0
