"""Near-duplicate embeddings against all cosines, recall of the index, and edge cases."""

import numpy as np
import pytest

from tidewire.llm import common, pivots


def plain(rows, threshold=0.93):
    """rows: (vec_id, label, vector or None); links by all cosines."""
    ok = [v is not None and lab is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, lab, v in rows]
    links, reach = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while reach[k] != k:
            k = reach[k]
        return k

    by_label = {}
    for k, (_, lab, v) in enumerate(rows):
        if ok[k]:
            by_label.setdefault((lab, len(v)), []).append(k)
    for members in by_label.values():
        x = np.array([rows[k][2] for k in members], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = x @ x.T
        for a, b in zip(*np.nonzero(np.triu(c >= threshold, 1)), strict=True):
            a, b = members[a], members[b]
            links[a] += 1
            links[b] += 1
            a, b = root(a), root(b)
            reach[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    out = []
    for k, (i, _, _) in enumerate(rows):
        component = None if i is None else low[root(k)]
        out.append((i, links[k], component, i is None or i == component))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=repr)


def near(rng, v, cosine):
    """A vector at exactly this cosine."""
    w = rng.standard_normal(len(v))
    w -= (w @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


@pytest.fixture(scope="module")
def planted():
    """Unrelated vectors, near copies, chains, exact copies, a large group and pairs just off the threshold."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((900, 32))
    rows = [(k, k % 3, v) for k, v in enumerate(base)]
    rows += [(1000 + k, k % 3, near(rng, base[k], 0.97)) for k in range(60)]
    rows += [(2000 + k, 0, base[3] * (k + 1)) for k in range(5)] + [(2100 + k, 1, base[3]) for k in range(5)]
    chain = base[6]
    for k in range(8):
        chain = near(rng, chain, 0.935)
        rows.append((3000 + k, 0, chain))
    rows += [(4000 + k, 2, base[8] + 0.06 * rng.standard_normal(32)) for k in range(500)]
    rows += [(5000 + k, k % 3, near(rng, base[300 + k], 0.9299)) for k in range(20)] + [(6000 + k, k % 3, near(rng, base[400 + k], 0.9302)) for k in range(60)]
    return [(i, lab, [float(x) for x in v]) for i, lab, v in rows]


SCHEMA = "vec_id long, label int, embedding array<double>"


def test_equals_all_cosines(spark, planted, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 150)  # hot lists are split
    df = spark.createDataFrame(planted, SCHEMA).repartition(5)
    out, want = got(pivots.near_embeddings(df)), plain(planted)
    missed = [(a, b) for a, b in zip(out, want, strict=True) if a != b]
    assert sum(w[1] for w in want) - sum(o[1] for o in out) <= 4 and len(missed) <= 8, missed
    assert all(o[1] <= w[1] for o, w in zip(out, want, strict=True))


def test_query_equals_all_cosines(spark, sf):
    rows = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in common.table(spark, sf, "embeddings").collect()]
    assert got(pivots.op11_embedding_near_dedup(spark, sf)) == plain(rows)


def test_recall_of_the_index():
    rng, index = np.random.default_rng(2), pivots.Index()
    p = pivots.choose(pivots.unit(rng.standard_normal((500, 64))), index)
    assert p.shape == (index.pivots, 64)
    u = pivots.unit(rng.standard_normal((4000, 64)))
    for cosine, least in ((0.93, 0.998), (0.97, 0.9995)):
        v = np.array([near(rng, x, cosine) for x in u])
        a, b = (pivots.prefixes(x, p, index.prefix) for x in (u, v))
        shared = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
        assert (shared >= index.shared).mean() >= least
    near_ = -(u[:5] @ p.T)
    assert (pivots.prefixes(u[:5], p, 10) == np.argsort(near_, axis=1, kind="stable")[:, :10]).all()


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [
        (1, 0, v), (2, 0, v), (2, 0, v), (3, None, v), (None, 0, v), (4, 0, None), (5, 0, []), (6, 0, [0.0, 0.0, 0.0]), (7, 0, [1.0, nan, 3.0]), (8, 0, [1.0, None, 3.0]), (9, 0, [1.0, 2.0, inf]),
        (10, 0, [1.0, 2.0]), (11, 0, [2.0, 4.0]), (12, 1, v), (13, 0, [1e200, 2e200, 3e200]), (14, 0, [1e-200, 2e-200, 3e-200]), (-5, 0, w), (2, 0, w), (15, 1, w),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS node", "7 AS n", "7 AS prefix", "7 AS place", "7 AS ok", "7 AS lo", "7 AS component_id").repartition(3)
    scaled = [(i, lab, [x / 1e200 for x in u] if i == 13 else [x / 1e-200 for x in u] if i == 14 else u) for i, lab, u in rows]
    assert got(pivots.near_embeddings(df)) == plain(scaled)
    assert pivots.near_embeddings(df.where("FALSE")).count() == 0
    assert got(pivots.near_embeddings(df.where("vec_id IN (4, 6)"))) == [(4, 0, 4, True), (6, 0, 6, True)]
    floats = df.select("vec_id", "label", df.embedding.cast("array<float>").alias("embedding")).where("vec_id IN (1, 2, 12)")
    assert got(pivots.near_embeddings(floats)) == plain([r for r in rows if r[0] in (1, 2, 12)])
