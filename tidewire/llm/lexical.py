"""Ranked lexical search over inverted treaps.

1. Forward table. Every document becomes its distinct terms with their counts and its length, written once. Numbers of
   documents and terms, and the documents that hold a term, are aggregates of that table over all documents.
2. Shards. A partition's documents are taken some at a time (`SHARD` postings). A shard holds one treap for each term of
   the queries: a binary search tree by document in doc_id order, and a heap by impact, so that a subtree's root has the
   subtree's largest impact.
3. Traverse. The treaps of a query's terms are walked together over ranges of documents. A range's bound is the sum of
   its treaps' maxima there; ranges that can't enter the best k are dropped with all the subtrees in them. Of the others,
   those with the largest bounds come first: the document with the largest single impact is scored in full, and the
   ranges on both sides of it go on. Many ranges of many queries move together as arrays.
4. A task keeps the best k of its shards for each query; a window ranks the tasks' results.

Queries go in blocks of bounded size (`BLOCK` terms), so that what is sent to the executors is bounded whatever their
number. Nothing is shuffled by document; a frequent term is spread over all shards.

Scores are integers; equal scores are ranked by doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Postings of a shard, terms of a block of queries, ranges of a query that move in one step, and pointers moved at once.
SHARD, BLOCK, STEP, POINTERS = 2_000_000, 100_000, 48, 400_000

#: Bytes of UTF-8 to term bytes: digits, letters (A-Z as a-z) and all beyond ASCII; the others separate terms.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(_FOLD).split()


FORWARD = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def forward(rows: DataFrame, key: str, text: str) -> DataFrame:
    """For each row: key (a long), n (terms with repeats), its distinct terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            counted = [Counter(f) for f in found]
            ends = np.cumsum([0] + [len(c) for c in counted]).astype(np.int32)
            flat = pa.array([t for c in counted for t in c], pa.binary()).cast(pa.string())
            counts = pa.array(np.fromiter((x for c in counted for x in c.values()), dtype=np.int64, count=ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, counts)], schema=FORWARD)

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, n long, terms array<string>, counts array<long>")


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's share of a document's score before its weight."""
    m = 100 - 75 + 75 * n * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Treaps:
    """One treap for each term over a shard's postings, which lie in order of term, then document.

    doc: the document's place in the shard (places are in doc_id order); high: impact; left, right: children, and root: by
    term; -1 is none. Of equal impacts the earlier document is above."""

    doc: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray

    @staticmethod
    def of(term: np.ndarray, doc: np.ndarray, high: np.ndarray, n_terms: int) -> Treaps:
        order = np.lexsort((doc, term))
        term, doc, high = term[order], doc[order], high[order]
        n = len(term)
        at = np.arange(n)
        first, last = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        first[1:] = last[:-1] = term[1:] != term[:-1]
        before = _nearest(np.where(first, -1, at - 1), lambda j, i: high[j] < high[i])
        after = _nearest(np.where(last, -1, at + 1), lambda j, i: high[j] <= high[i])
        # the parent is the lower of the nearest higher neighbours
        to_left = (before >= 0) & ((after < 0) | (high[before] < high[after]))
        to_right = (after >= 0) & ~to_left
        left, right, root = np.full(n, -1), np.full(n, -1), np.full(n_terms, -1)
        right[before[to_left]] = at[to_left]
        left[after[to_right]] = at[to_right]
        top = ~(to_left | to_right)
        root[term[top]] = at[top]
        return Treaps(doc, high, left, right, root)

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest node at or below each one whose document lies between low and high, both excluded."""
        node = node.copy()
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            now = node[open_]
            d = self.doc[now]
            less, more = d <= low[open_], d >= high[open_]
            open_, now, less = open_[less | more], now[less | more], less[less | more]
            node[open_] = np.where(less, self.right[now], self.left[now])
            open_ = open_[node[open_] >= 0]
        return node

    def at(self, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impact of each document by a search downwards from a node above it; 0 where it isn't there."""
        out = np.zeros(len(node), dtype=np.int64)
        open_ = np.flatnonzero(node >= 0)
        now, doc = node[open_], doc[open_]
        while len(open_):
            d = self.doc[now]
            hit = d == doc
            out[open_[hit]] = self.high[now[hit]]
            now = np.where(d < doc, self.right[now], self.left[now])
            go = (now >= 0) & ~hit
            open_, now, doc = open_[go], now[go], doc[go]
        return out


def _nearest(step: np.ndarray, lower) -> np.ndarray:
    """Follows each place's pointer past lower places, all at once, and the few that are left one by one."""
    open_ = np.flatnonzero(step >= 0)
    for _ in range(64):
        open_ = open_[lower(step[open_], open_)]
        if not len(open_):
            return step
        step[open_] = step[step[open_]]
        open_ = open_[step[open_] >= 0]
    forwards = len(open_) and step[open_[0]] > open_[0]
    for i in open_[::-1] if forwards else open_:
        while step[i] >= 0 and lower(step[i], i):
            step[i] = step[step[i]]
    return step


@dataclass
class Queries:
    """A block of queries: number and id of each, and its terms' numbers and weights (repeats counted in)."""

    numbers: list[int]
    vocabulary: pa.Array
    terms: list[np.ndarray]
    weights: list[np.ndarray]


class Best:
    """The best k documents of each query so far: by score, then doc_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.query, self.score, self.doc = (np.empty(0, dtype=np.int64) for _ in range(3))
        #: what a document must beat: the k-th score and its doc_id, or 0.
        self.floor, self.floor_doc = np.zeros(queries, dtype=np.int64), np.full(queries, np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score > 0
        q, s, d = (np.concatenate(x) for x in ((self.query, query[good]), (self.score, score[good]), (self.doc, doc[good])))
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]], self.floor_doc[q[last]] = s[last], d[last]
        keep = rank < self.k
        self.query, self.score, self.doc = q[keep], s[keep], d[keep]

    def may_enter(self, query: np.ndarray, bound: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
        """Whether documents from first_doc on with at most this score can be among the best."""
        return (bound > self.floor[query]) | (bound == self.floor[query]) & (bound > 0) & (first_doc < self.floor_doc[query])


def search_shard(treaps: Treaps, ids: np.ndarray, queries: Queries, best: Best, step: int = STEP) -> int:
    """Adds the shard's best documents; ids: doc_ids in order. Returns the number of documents scored."""
    scored = 0
    if not len(ids):
        return 0
    by_size = np.argsort([len(t) for t in queries.terms], kind="stable")
    start = 0
    while start < len(by_size):
        # queries of similar numbers of terms together, as many as the pointers of one step allow
        end = start + 1
        while end < len(by_size) and (end + 1 - start) * step * len(queries.terms[by_size[end]]) <= POINTERS:
            end += 1
        scored += _search(treaps, ids, queries, by_size[start:end], best, step)
        start = end
    return scored


def _search(treaps: Treaps, ids: np.ndarray, queries: Queries, chosen: np.ndarray, best: Best, step: int) -> int:
    width = max(len(queries.terms[q]) for q in chosen)
    if not width:
        return 0
    weights = np.zeros((len(chosen), width), dtype=np.int64)
    node = np.full((len(chosen), width), -1)
    for i, q in enumerate(chosen):
        weights[i, : len(queries.terms[q])] = queries.weights[q]
        node[i, : len(queries.terms[q])] = treaps.root[queries.terms[q]]
    high = np.append(treaps.high, 0)  # at -1: nothing
    mine = np.arange(len(chosen))
    low, top = np.full(len(chosen), -1), np.full(len(chosen), len(ids))
    bound = (high[node] * weights).sum(axis=1)
    scored = 0
    while len(mine):
        # ranges that can't enter any more go; of the others some of each query move on
        keep = best.may_enter(chosen[mine], bound, ids[np.minimum(low + 1, len(ids) - 1)])
        mine, low, top, bound, node = mine[keep], low[keep], top[keep], bound[keep], node[keep]
        if not len(mine):
            break
        order = np.lexsort((low, -bound, mine))
        rank = np.empty(len(mine), dtype=np.int64)
        rank[order] = np.arange(len(mine)) - np.searchsorted(mine[order], mine[order])
        go = rank < step
        m, lo, hi, ptr = mine[go], low[go], top[go], node[go]
        share = high[ptr] * weights[m]
        pick = treaps.doc[ptr[np.arange(len(m)), share.argmax(axis=1)]]
        scored += len(m)
        wide = lambda x: np.repeat(x, width)
        flat, flat_pick, flat_lo, flat_hi = ptr.ravel(), wide(pick), wide(lo), wide(hi)
        here = treaps.at(flat, flat_pick).reshape(ptr.shape)
        best.add(chosen[m], (here * weights[m]).sum(axis=1), ids[pick])
        below = treaps.within(flat, flat_lo, flat_pick).reshape(ptr.shape)
        above = treaps.within(flat, flat_pick, flat_hi).reshape(ptr.shape)
        stay = ~go
        mine, low, top = np.concatenate([mine[stay], m, m]), np.concatenate([low[stay], lo, pick]), np.concatenate([top[stay], pick, hi])
        bound = np.concatenate([bound[stay], (high[below] * weights[m]).sum(axis=1), (high[above] * weights[m]).sum(axis=1)])
        node = np.concatenate([node[stay], below, above])
    return scored


def _best_of_task(batches: Iterator[pa.RecordBatch], queries: Queries, k: int, documents: int, total: int, shard: int) -> Iterator[pa.RecordBatch]:
    best, held, size = Best(len(queries.numbers), k), [], 0

    def flush() -> None:
        ids = np.concatenate([h[0] for h in held])
        first = np.cumsum([0] + [len(h[0]) for h in held])
        row = np.concatenate([h[1] + f for h, f in zip(held, first, strict=False)])
        place = np.empty(len(ids), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        place[order] = np.arange(len(ids))
        treaps = Treaps.of(np.concatenate([h[2] for h in held]), place[row], np.concatenate([h[3] for h in held]), len(queries.vocabulary))
        search_shard(treaps, ids[order], queries, best)
        held.clear()

    for batch in batches:
        ends = np.diff(batch.column("terms").offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), ends)
        term = pc.index_in(batch.column("terms").flatten(), value_set=queries.vocabulary)
        known = pc.is_valid(term).to_numpy(zero_copy_only=False)
        tf = batch.column("counts").flatten().to_numpy()[known]
        row = row[known]
        high = impact(tf, batch.column("n").to_numpy()[row], documents, total)
        held.append((batch.column("key").to_numpy(), row, pc.drop_null(term).to_numpy().astype(np.int64), high))
        size += len(row)
        if size >= shard:
            flush()
            size = 0
    if held:
        flush()
    yield pa.RecordBatch.from_pydict({"query": pa.array([queries.numbers[q] for q in best.query], pa.int64()), "doc_id": pa.array(best.doc), "score": pa.array(best.score)})


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The k best documents for each item: item_id, rank (from 1), doc_id, score.

    docs: doc_id, text; items: item_id, text; other columns are ignored. A row of docs is a document, so rows that repeat a
    doc_id are ranked each by itself (the order of equal ones is open and makes no difference); rows with a null doc_id count
    in the statistics but aren't ranked. A row of items is a query, so a repeated row gives its ranking again; a null item_id
    is kept. Null and empty texts, and texts without a term, hold no term: such documents aren't counted, such items have no
    result. An empty table on either side gives no rows. Documents and items may be of any length.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    held = common.materialize(forward(docs, "doc_id", "text"), "forward")
    documents, total = held.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = common.materialize(items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id"), "text"), "items")
    named = asked.select("query", "item_id")
    entries = forward(asked, "query", "text").select(F.col("key").alias("query"), F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("query", F.col("x.terms").alias("term"), F.col("x.counts").alias("repeats"))
    # counts of all terms are summed before they meet those of the queries, so a frequent term is no hot key
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))
    entries = common.materialize(entries.join(df, "term").withColumn("weight", weight * F.col("repeats")).where("weight > 0").select("query", "term", "weight"), "query_terms")
    blocks, path = -(-entries.count() // block), common.new_path(spark, "best")
    found = None
    for b in range(blocks):
        part = entries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).orderBy("query", "term").toArrow()  # about `block` rows
        if part.num_rows:
            run = partial(_best_of_task, queries=_queries(part), k=k, documents=documents, total=total, shard=shard)
            found = held.where("key IS NOT NULL AND n > 0").mapInArrow(run, "query long, doc_id long, score long")
            if blocks > 1:
                found.write.mode("append").parquet(path)
    if found is None:
        return named.where("FALSE").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    every = found if blocks == 1 else spark.read.schema(found.schema).parquet(path)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return every.withColumn("rank", place).where(F.col("rank") <= k).join(named, "query").select("item_id", "rank", "doc_id", "score")


def _queries(part: pa.Table) -> Queries:
    query = part.column("query").to_numpy()
    coded = part.column("term").combine_chunks().dictionary_encode()
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    cut = lambda x: np.split(x, starts[1:])
    return Queries(query[starts].tolist(), coded.dictionary, cut(coded.indices.to_numpy().astype(np.int64)), cut(part.column("weight").to_numpy()))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM doc_terms WHERE len(w) > 0
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes
), counts AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc_terms) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM counts, whole GROUP BY term, nn
), asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
