"""Near-duplicate detection with SetSketch registers, exact on full shingle sets.

1. Sketch. A document's set of word shingles becomes `Sketch.registers` SetSketch registers: every
   register is the truncated, exponentially spaced level of the smallest of the set's exponential hash
   values. Sketches of two sets merge by taking the larger register (`merge`).
2. Collapse. Documents with equal sets are one node, with a number of its own and their smallest doc_id.
3. Band. Groups of `Sketch.rows` registers are hashed; nodes that share a band meet in a bucket. A
   bucket beyond `BLOCK` nodes is split into blocks, and pairs of blocks are compared apart, so no task
   holds a hot bucket.
4. Estimate. In a bucket, the similarity of two nodes is estimated jointly by maximum likelihood from the
   counts of equal, larger and smaller registers and the known set sizes; pairs far below the threshold
   go. In a larger bucket components grow from one node each, and nodes that have joined aren't compared again, so a bucket
   of near copies takes one comparison a node and block. A bucket emits a star for each component, never its pairs.
5. Verify. Nodes of one estimated component are compared on their full sets (split into blocks in the
   same way), and each block emits a star for each of its exact components.
6. The exact links' connected components are the groups.

A pair at similarity 0.85 shares no band with a chance of about 2e-8 (at 0.80, about 3e-6), and `MARGIN` is 5.2 standard
deviations of the estimate at 0.85 and 4.65 at 0.80, so links are not lost in practice; links that are reported are always exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Nodes of a bucket or estimated component that are compared in one task, and shingles held for it.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: How far below the threshold an estimate may lie for its pair to be verified.
MARGIN = 0.19
#: Groups from so many nodes on are grown component by component instead of comparing every pair.
GROWN = 12


@dataclass(frozen=True)
class Sketch:
    """SetSketch parameters: registers m, base b, rate a, levels q, and registers in a band."""

    registers: int = 96
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    levels: int = 65534
    seed: int = 20240101

    @property
    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        draw = lambda: rng.integers(1, 2**63, self.registers, dtype=np.uint64)
        return draw() * np.uint64(2) + np.uint64(1), draw()

    def level(self, least: np.ndarray) -> np.ndarray:
        """Registers of the least uniform 64-bit hash values."""
        u = (least.astype(np.float64) + 0.5) * 2.0**-64
        x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / self.rate
        return np.clip(np.floor(1 - np.log(x) / np.log(self.base)), 0, self.levels + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POSITION = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Hashes(dict):
    """64-bit hashes of words, kept within a bound."""

    BOUND = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z count as a-z.

    Words are runs of anything but space and \\t to \\r. A text of fewer words than `size` is one
    shingle; a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    width = min(size, n)
    x = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        x = mix(x + h[k : n - width + 1 + k]) * _POSITION[k % len(_POSITION)]
    return np.unique(mix(x))


def sketches(sets: list[np.ndarray], sketch: Sketch) -> np.ndarray:
    """Registers of non-empty sets, a row for each."""
    out = np.empty((len(sets), sketch.registers), dtype=np.uint16)
    a, b = sketch.factors
    k = 0
    while k < len(sets):
        end, n = k, 0
        while end < len(sets) and (n == 0 or n + len(sets[end]) <= 60_000):
            n += len(sets[end])
            end += 1
        x = np.concatenate(sets[k:end])
        starts = np.cumsum([0] + [len(s) for s in sets[k : end - 1]])
        v = np.empty_like(x)
        least = np.empty((sketch.registers, end - k), dtype=np.uint64)
        for i in range(sketch.registers):
            np.multiply(x, a[i], out=v)
            np.add(v, b[i], out=v)
            least[i] = np.minimum.reduceat(v, starts)
        out[k:end] = sketch.level(least).T
        k = end
    return out


def estimate(equal: np.ndarray, more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, base: float) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity.

    equal, more, less: numbers of registers in which u equals, exceeds and is below v; n_u, n_v: set sizes."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (base - 1) / base) / np.log(base)
    best, value = np.zeros(len(u)), np.full(len(u), -np.inf)
    for step in np.linspace(0, 1, 101):
        j = top * step
        p1, p2 = p(u - v * j), p(v - u * j)
        score = more * np.log(p1) + less * np.log(p2) + equal * np.log(np.clip(1 - p1 - p2, 1e-12, 1))
        better = score > value
        best[better], value[better] = j[better], score[better]
    return best


def reaches(equal: np.ndarray, more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, base: float, least: float) -> np.ndarray:
    """Whether estimate() is at least `least`, without solving for it: the likelihood is concave, so its peak lies there
    exactly if it still rises at the last step of the grid below."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    step = np.ceil(least / top * 100 - 1e-9)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (base - 1) / base) / np.log(base)

    def score(j: np.ndarray) -> np.ndarray:
        p1, p2 = p(u - v * j), p(v - u * j)
        return more * np.log(p1) + less * np.log(p2) + equal * np.log(np.clip(1 - p1 - p2, 1e-12, 1))

    return (step <= 100) & ((step <= 0) | (score(top * np.clip(step, 0, 100) / 100) > score(top * np.clip(step - 1, 0, 100) / 100)))


def grown(nodes: np.ndarray, similar) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, centre) of the single-linkage components of some rows; similar(a, b) compares rows pairwise.

    A component grows from its first row: what it reaches is taken out of the rest before its members look further, so
    a row is compared with those of its own component only until it joins. A group of near copies takes one pass."""
    member, centre = [], []
    rest = nodes
    while len(rest) > 1:
        start, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), dtype=bool)
            # the front meets what is left of the rest, some of it at a time
            step = max(1, 50_000 // len(rest))
            for k in range(0, len(front), step):
                open_ = np.flatnonzero(~hit)
                part = front[k : k + step]
                hit[open_] = similar(np.repeat(part, len(open_)), np.tile(rest[open_], len(part))).reshape(len(part), -1).any(axis=0)
                if hit.all():
                    break
            front, rest = rest[hit], rest[~hit]
            member.append(front)
            centre.append(np.full(len(front), start))
    whole = lambda x: np.concatenate([*x, []]).astype(np.int64)
    return whole(member), whole(centre)


def sketched(docs: DataFrame, sketch: Sketch, size: int) -> DataFrame:
    """For each row: doc_id, copy (a hash of the text), n_shingles, signature of the set (null if empty), registers, bands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(t, size) for t in frame["text"]]
            some = [k for k, s in enumerate(sets) if len(s)]
            regs = sketches([sets[k] for k in some], sketch)
            out = pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "copy": frame["copy"], "n_shingles": [len(s) for s in sets], "signature": None, "registers": None}).astype({"signature": object, "registers": object})
            for r, k in enumerate(some):
                out.iat[k, 3] = xxhash.xxh3_128_digest(sets[k].tobytes())
                out.iat[k, 4] = regs[r].tobytes()
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text").mapInPandas(run, "doc_id long, copy long, n_shingles long, signature binary, registers binary")


def _blocks(rows: DataFrame, key: str, parts: str) -> DataFrame:
    """rows with a column of block numbers `parts`, repeated for each pair of blocks: adds lo <= hi."""
    own = F.pmod(F.xxhash64("node", F.lit(17)), F.col(parts))
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("own", "other", parts)
    )


def _bucket_links(threshold: int, sketch: Sketch, margin: float):
    """Stars of the estimated components in each bucket block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = ["bucket", "lo", "hi"]
        for frame in common.whole_groups(frames, key):
            cuts = common.group_bounds(frame, key)
            nodes, n = frame["node"].to_numpy(), frame["n_shingles"].to_numpy().astype(np.float64)
            regs = np.frombuffer(b"".join(frame["registers"]), dtype=np.uint16).reshape(len(frame), sketch.registers)

            def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                keep = 100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
                close = np.flatnonzero(keep)
                for k in range(0, len(close), 50_000):
                    s = close[k : k + 50_000]
                    x, y = regs[a[s]], regs[b[s]]  # noqa: B023
                    equal, more = (x == y).sum(axis=1), (x > y).sum(axis=1)
                    keep[s] = reaches(equal, more, sketch.registers - equal - more, n[a[s]], n[b[s]], sketch.base, threshold / 100 - margin)
                return keep

            sizes = np.diff(cuts)
            left, right = [], []
            for a, b in _pairs(cuts, sizes < GROWN):
                keep = similar(a, b)
                left.append(a[keep])
                right.append(b[keep])
            for k in np.flatnonzero(sizes >= GROWN):
                a, b = grown(np.arange(cuts[k], cuts[k + 1]), similar)
                left.append(a)
                right.append(b)
            yield _stars(nodes, np.concatenate([*left, []]).astype(np.int64), np.concatenate([*right, []]).astype(np.int64))

    return run


def _pairs(cuts: np.ndarray, chosen: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs within each chosen group, some groups at a time."""
    sizes = np.where(chosen, np.diff(cuts), 0)
    two = cuts[:-1][sizes == 2]
    if len(two):
        yield two, two + 1
    left, right, held = [], [], 0
    for start, size in zip(cuts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
        a, b = np.triu_indices(size, 1)
        left.append(a + start)
        right.append(b + start)
        held += len(a)
        if held > most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


def _stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links from each linked row to the smallest linked one that it reaches."""
    used, where = np.unique(np.concatenate([nodes[a], nodes[b]]), return_inverse=True)
    label = common.local_components(len(used), where[: len(a)], where[len(a) :])
    moved = label != np.arange(len(used))
    return pd.DataFrame({"a": used[moved], "b": used[label[moved]]})


def _exact_links(threshold: int):
    """Stars of the exact components in each block of an estimated component."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = ["component", "lo", "hi"]
        for frame in common.whole_groups(frames, key, rows=2000):
            cuts = common.group_bounds(frame, key)
            nodes = frame["node"].to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
            left, right = [], []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                a, b = verified(sets[start:end], threshold)
                left.append(a + start)
                right.append(b + start)
            yield _stars(nodes, np.concatenate(left), np.concatenate(right))

    return run


def verified(sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b of sets with 100 * intersection >= threshold * union."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) <= 8:
        found = []
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if 100 * min(n[i], n[j]) >= threshold * max(n[i], n[j]):
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * shared >= threshold * (n[i] + n[j] - shared):
                        found.append((i, j))
        return np.array([i for i, _ in found], dtype=np.int64), np.array([j for _, j in found], dtype=np.int64)
    # an incidence-matrix product over the shingles that at least two sets have, some columns at a time
    words, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), n)
    common_words = np.bincount(where, minlength=len(words)) > 1
    number = np.cumsum(common_words) - 1
    inside = common_words[where]
    rows, cols = rows[inside], number[where[inside]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    for c in range(0, int(common_words.sum()), width):
        lo, hi = np.searchsorted(cols, [c, c + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[rows[lo:hi], cols[lo:hi] - c] = 1
        shared += m @ m.T
    union = n[:, None] + n[None, :] - shared
    a, b = np.nonzero(np.triu(100 * shared >= threshold * union, 1))
    return a, b


def near_duplicates(docs: DataFrame, threshold: int = 80, size: int = 5, sketch: Sketch = Sketch(), margin: float = MARGIN) -> DataFrame:
    """Groups of documents whose shingle sets reach a Jaccard similarity of threshold percent.

    docs: doc_id and text, other columns are ignored. Returns for each row doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, its own included), kept (doc_id =
    component_id) and copy (a hash of the text). Null and empty texts, and texts of white space, have 0 shingles and no links. Rows
    with a null doc_id take part in no link, have a null component_id and are kept. Rows that repeat a
    doc_id each get the component of their own text.
    """
    common.small_batches(docs.sparkSession)
    rows = common.materialize(sketched(docs, sketch, size), "sketches")
    some = rows.where("signature IS NOT NULL AND doc_id IS NOT NULL")
    # a repeated doc_id may stand for several sets, so nodes are numbered apart from it; copy tells its rows' texts apart
    least = some.groupBy("signature").agg(F.min(F.struct("doc_id", "copy", "n_shingles", "registers")).alias("x"))
    nodes = common.materialize(least.select(F.monotonically_increasing_id().alias("node"), "signature", "x.doc_id", "x.copy", "x.n_shingles", "x.registers"), "nodes")
    bands = sketch.registers // sketch.rows
    width = 2 * sketch.rows
    banded = nodes.select(
        "node",
        F.explode(F.array(*[F.xxhash64(F.substring("registers", 1 + k * width, width), F.lit(k)) for k in range(bands)])).alias("bucket"),
    )
    sizes = banded.groupBy("bucket").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / BLOCK)).drop("count")
    members = _blocks(banded.join(sizes, "bucket"), "bucket", "parts")
    members = members.join(nodes.select("node", "n_shingles", "registers"), "node")
    stars = members.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node").select("bucket", "lo", "hi", "node", "n_shingles", "registers")
    guessed = common.components(stars.mapInPandas(_bucket_links(threshold, sketch, margin), "a long, b long"))

    grouped = guessed.join(nodes.select("node", "n_shingles"), "node")
    sizes = grouped.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    to_check = _blocks(grouped.join(sizes, "component").drop("n_shingles"), "component", "parts")

    def full_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"node": frame["node"], "shingles": [shingles(t, size).tobytes() for t in frame["text"]]})

    # each node by the row that it was made from; rows that repeat doc_id and text give its set more than once, which does no harm
    asked = guessed.select("node").join(nodes.select("node", F.col("doc_id").alias("n_doc"), F.col("copy").alias("n_copy")), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("t_doc"), F.xxhash64("text").alias("t_copy"), "text")
    texts = texts.join(asked, (F.col("t_doc") == F.col("n_doc")) & (F.col("t_copy") == F.col("n_copy"))).select("node", "text")
    sets = texts.mapInPandas(full_sets, "node long, shingles binary")
    blocks = to_check.join(sets, "node").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "node").select("component", "lo", "hi", "node", "shingles")
    linked = common.components(blocks.mapInPandas(_exact_links(threshold), "a long, b long"))

    mine = nodes.select("signature", "node", "doc_id").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mine = common.materialize(mine, "members")
    lowest = mine.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    named = common.spread_join(mine.select("signature", "component"), common.materialize(lowest, "lowest"), ["component"], "n").select("signature", "component_id")
    out = rows.select("doc_id", "copy", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("signature")).alias("signature")).join(named, "signature", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "copy")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "copy")


def without_near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each group the row with the smallest doc_id.

    Rows that repeat a doc_id and text stay or go together."""
    return common.without(docs, near_duplicates(docs, threshold).where("NOT kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at 85 percent."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), threshold=85).drop("copy")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), members AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN low ON low.a = sets.doc_id
"""
