"""Ranked search against a plain version, the treaps' invariants, and edge cases. The SQL is compared in test_sql."""

import math
import re
from collections import Counter

import numpy as np

from tidewire.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """All scores by definition; docs and items: (id, text)."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    big_n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * big_n // total
            s = sum(r * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(words(text)).items() if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def test_terms_are_the_contracts():
    text = "".join(map(chr, range(0x250))) + " ÀÉ naïve 🚨x KelvinK İ a_b-c A1B2 z"
    assert [t.decode() for t in lexical.terms(text.encode())] == words(text)
    assert lexical.terms(None) == lexical.terms(b" .,") == []


def test_treaps_hold_order_and_heap():
    rng = np.random.default_rng(3)
    shapes = [rng.integers(0, 50, 400), np.arange(300), np.arange(300)[::-1], np.append(np.arange(500)[::-1], 900), np.zeros(64, dtype=np.int64), np.tile(np.append(np.arange(90)[::-1], 99), 4)]
    term = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    doc = np.concatenate([rng.permutation(2 * len(s))[: len(s)] for s in shapes])
    t = lexical.Treaps.of(term, doc, np.concatenate(shapes), len(shapes) + 1)
    assert t.root[-1] == -1

    def walk(node):
        if node < 0:
            return []
        for child in (t.left[node], t.right[node]):
            assert child < 0 or t.high[child] <= t.high[node]
        a, b = walk(t.left[node]), walk(t.right[node])
        return [*a, node, *b]

    import sys

    sys.setrecursionlimit(5000)
    seen = []
    for k in range(len(shapes)):
        nodes = walk(t.root[k])
        assert [t.doc[n] for n in nodes] == sorted(doc[term == k])
        seen += nodes
    assert sorted(seen) == list(range(len(term)))


def test_pruned_search_equals_all_scores(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(300)]
    p = 1 / np.arange(1, 301)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    docs = [(int(k), text(int(rng.integers(1, 60)))) for k in rng.permutation(1500)]
    items = [(k, text(int(rng.integers(1, 40)))) for k in range(25)]
    docs += [(5000 - k, items[3][1]) for k in range(40)]  # equal scores: the smallest doc_ids win
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert got(lexical.ranked(d, i)) == want
    assert got(lexical.ranked(d, i, block=100, shard=2000)) == want  # many blocks of queries, many shards
    assert got(lexical.ranked(d, i, k=3)) == plain(docs, items, 3)


def test_search_scores_few_documents():
    rng = np.random.default_rng(9)
    n, rare = 20_000, 40
    doc = np.concatenate([np.arange(n), np.sort(rng.choice(n, rare, replace=False))])
    term = np.repeat([0, 1], [n, rare])
    high = np.concatenate([rng.integers(1, 1000, n), rng.integers(1, 1000, rare)])
    import pyarrow as pa

    q = lexical.Queries([0], pa.array(["a", "b"]), [np.array([0, 1])], [np.array([1, 50])])
    best = lexical.Best(1, 10)
    scored = lexical.search_shard(lexical.Treaps.of(term, doc, high, 2), np.arange(n), q, best, step=8)
    full = np.zeros(n, dtype=np.int64)
    np.add.at(full, doc, high * np.array([1, 50])[term])
    assert sorted(best.score.tolist()) == np.sort(full)[-10:].tolist() and scored < n / 50


def test_edges(spark):
    long = " ".join(f"word{k % 977}" for k in range(40_000))
    docs = [(1, "Red fox"), (2, None), (3, ""), (4, " .,!\n"), (5, long), (6, "red RED fox fox"), (7, "red fox"), (7, "red fox"), (7, "blue fox"), (None, "red fox"), (8, "É é 🚨"), (-9, "red"), (10, "x y z")]
    items = [(1, "RED fox!"), (2, None), (3, "?"), (None, "red"), (1, "RED fox!"), (4, long), (5, "absent words"), (6, "é 🚨 É")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS key", "7 AS rank", "7 AS score", "7 AS n", "'x' AS item_id", "7 AS query")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS doc_id", "7 AS df", "7 AS weight", "7 AS term", "7 AS query")
    assert got(lexical.ranked(d.repartition(4), i)) == plain(docs, items)
    assert lexical.ranked(d.where("FALSE"), i).count() == lexical.ranked(d, i.where("FALSE")).count() == 0
    assert [c for c, _ in lexical.ranked(d, i.where("item_id = 2")).dtypes] == ["item_id", "rank", "doc_id", "score"]
