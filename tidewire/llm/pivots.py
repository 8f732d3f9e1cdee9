"""Near-duplicate embeddings by a pivot-permutation index.

1. Collapse. Rows with equal label and vector are one node with a number of rows.
2. Describe. A node's permutation prefix is its `Index.prefix` nearest pivots, in order. Pivots are reference vectors drawn
   from a bounded sample, none close to another, filled up with fixed random directions to `Index.pivots`.
3. Retrieve. Two nodes of a label are candidates if they share `Index.shared` pivots or more. An inverted list stands for
   `Index.together` pivots at once, so that nodes which share one frequent pivot don't meet: a node lies in the list of each
   combination of its pivots (of its first ones by number: what shares enough has its smallest shared pivots there). A pair
   that meets in several lists counts in one, that of its smallest shared pivots, which both prefixes tell; there its shared
   pivots are counted. Lists beyond `BLOCK` nodes are split into pairs of blocks, so no task holds a hot list.
4. Verify. Nodes that have a candidate in a list meet there again with their vectors; cosines are exact, in double
   precision. A block gives each node's number of linked rows and a star for each of its components, never its pairs.
5. Components of the stars are the groups.

With the parameters given, a pair of 64-dimensional vectors at cosine 0.93 is missed with a chance of about 1e-3, at 0.95 of
3e-4 and from 0.97 on of less than 1e-4 (random directions, 12,000 pairs each); 0.02 % of unrelated pairs are compared. A
group of near copies that aren't equal takes as many products as it has pairs, in matrix products of blocks, as every row's exact
number of links is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

#: Nodes of a list that are compared in one task; groups from LARGE nodes on are compared by matrix products.
BLOCK, LARGE = 2048, 48


@dataclass(frozen=True)
class Index:
    """Number of pivots, length of a prefix, pivots that candidates share, pivots of a list, rows of the sample, and the
    cosine from which a sampled vector is too close to a pivot to be one."""

    pivots: int = 2048
    prefix: int = 12
    shared: int = 3
    together: int = 2
    sample: int = 8192
    close: float = 0.8
    seed: int = 20240101


@cache
def directions(count: int, width: int, seed: int) -> np.ndarray:
    """Fixed random unit vectors."""
    x = np.random.default_rng([seed, width]).standard_normal((count, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by a power of two first, so that no square leaves the range of doubles."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -power)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose(sample: np.ndarray, index: Index) -> np.ndarray:
    """Pivots from unit vectors: each one that isn't close to an earlier one, then random directions."""
    width = sample.shape[1]
    out = np.empty((index.pivots, width))
    n = 0
    for v in sample:
        if n == index.pivots:
            break
        if not n or (out[:n] @ v).max() < index.close:
            out[n] = v
            n += 1
    out[n:] = directions(index.pivots - n, width, index.seed)
    return out


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots of unit vectors, nearest first; ties by number."""
    near = -(x @ pivots.T)
    best = np.sort(np.argpartition(near, length - 1, axis=1)[:, :length], axis=1)
    return np.take_along_axis(best, np.argsort(np.take_along_axis(near, best, axis=1), axis=1, kind="stable"), axis=1)


def nodes_of(rows: DataFrame, index: Index) -> DataFrame:
    """Distinct usable vectors of a label: node, place (hash of label and width), h1 and h2 (hashes of the vector), first (the
    smallest vec_id), n (rows), prefix, and vector (bytes of its unit vector).

    rows: vec_id, place, h1, h2, embedding, of usable vectors."""
    held = rows.groupBy("place", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    held = common.materialize(held.withColumn("node", F.monotonically_increasing_id()), "vectors")
    width = vectors.common_width(held, "embedding")
    pivots = directions(index.pivots, max(width, 1), index.seed)
    if width:
        sample = held.where(F.size("embedding") == width).select("h1", "h2", "embedding").orderBy("h1", "h2").limit(index.sample).toArrow()
        pivots = choose(unit(vectors.matrix(sample.column("embedding").combine_chunks(), width)), index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            widths = np.diff(lists.offsets.to_numpy())
            prefix, vector = np.empty(len(widths), dtype=object), np.empty(len(widths), dtype=object)
            for w in np.unique(widths):
                chosen = np.flatnonzero(widths == w)
                x = unit(vectors.matrix(lists.take(pa.array(chosen)), int(w)))
                # vectors of another width than most have pivots of their own
                found = prefixes(x, pivots if w == width else directions(index.pivots, int(w), index.seed), index.prefix).astype(np.int16)
                for k, p, v in zip(chosen, found, x, strict=True):
                    prefix[k], vector[k] = p, v.tobytes()
            columns = [batch.column(c) for c in ("node", "place", "h1", "h2", "first", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(prefix), pa.list_(pa.int16())), pa.array(list(vector), pa.binary())], ["node", "place", "h1", "h2", "first", "n", "prefix", "vector"])

    picked = held.select("node", "place", "h1", "h2", "first", "n", F.col("embedding").cast("array<double>").alias("embedding"))
    return common.materialize(picked.mapInArrow(run, "node long, place long, h1 long, h2 long, first long, n long, prefix array<smallint>, vector binary"), "nodes")


LIST = ["place", "pivots", "lo", "hi"]


def lists(nodes: DataFrame, index: Index) -> DataFrame:
    """The inverted lists: place, pivots (the combination's pivots as one number, the largest first), node, prefix."""
    p = F.transform(F.array_sort("prefix"), lambda x: x.cast("long"))

    def number(places: tuple[int, ...]):
        out = F.element_at(p, places[-1] + 1)
        for k in reversed(places[:-1]):
            out = out * index.pivots + F.element_at(p, k + 1)
        return out

    return nodes.select("place", F.explode(F.array(*[number(c) for c in combinations(range(index.prefix - index.shared + index.together), index.together)])).alias("pivots"), "node", "prefix")


def blocked(rows: DataFrame) -> DataFrame:
    """rows of lists with their block `own`, once for each pair of blocks lo <= hi that it is in."""
    sizes = common.materialize(rows.groupBy("place", "pivots").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1"), "hot_lists")
    dealt = rows.join(sizes, ["place", "pivots"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(17)), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "parts")


def gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition(*LIST).sortWithinPartitions(*LIST, "node")


def candidates(frame: pd.DataFrame, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Pairs of rows to compare in a frame of whole lists: (a, b, None) by row numbers, some lists at a time, or, for a large
    list, (rows, columns, mask)."""
    cuts = common.group_bounds(frame, LIST)
    prefix = np.stack(frame["prefix"].to_numpy()).astype(np.int32) if len(frame) else np.empty((0, index.prefix), dtype=np.int32)
    last = frame["pivots"].to_numpy() // index.pivots ** (index.together - 1)
    own, lo, hi = (frame[c].to_numpy() for c in ("own", "lo", "hi"))
    sizes = np.diff(cuts)
    small = np.flatnonzero((sizes > 1) & (sizes < LARGE))
    for a, b in small_pairs(cuts[:-1][small], sizes[small]):
        # the smallest shared pivots are this list's: no others up to its last one
        p, q = prefix[a], prefix[b]
        both = (p[:, :, None] == q[:, None, :]).any(axis=2)
        good = ((both & (p <= last[a, None])).sum(axis=1) == index.together) & (both.sum(axis=1) >= index.shared) & ((lo[a] == hi[a]) | (own[a] != own[b]))
        yield a[good], b[good], None
    for k in np.flatnonzero(sizes >= LARGE):
        rows = np.arange(cuts[k], cuts[k + 1])
        cross = lo[rows[0]] != hi[rows[0]]
        left, right = (rows[own[rows] == lo[rows[0]]], rows[own[rows] == hi[rows[0]]]) if cross else (rows, rows)
        if not len(left) or not len(right):
            continue
        seen = np.zeros((len(rows), index.pivots), dtype=np.float32)
        seen[np.arange(len(rows))[:, None], prefix[rows]] = 1
        p, q, till = seen[left - rows[0]], seen[right - rows[0]], int(last[rows[0]]) + 1
        mask = (np.rint(p[:, :till] @ q[:, :till].T) == index.together) & (p @ q.T > index.shared - 0.5)
        yield left, right, mask if cross else np.triu(mask, 1)


def small_pairs(starts: np.ndarray, sizes: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of groups, at most about `most` at once."""
    for size in np.unique(sizes):
        a, b = np.triu_indices(size, 1)
        mine = starts[sizes == size]
        step = max(1, most // len(a))
        for k in range(0, len(mine), step):
            s = mine[k : k + step, None]
            yield (s + a).ravel(), (s + b).ravel()


def retrieved(rows: DataFrame, index: Index) -> DataFrame:
    """Of blocked lists, the entries that have a candidate in their list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.whole_groups(frames, LIST):
            some = np.zeros(len(frame), dtype=bool)
            for a, b, mask in candidates(frame, index):
                if mask is None:
                    some[a] = some[b] = True
                else:
                    some[a[mask.any(axis=1)]] = some[b[mask.any(axis=0)]] = True
            yield frame[some]

    kept = "place long, pivots long, lo long, hi long, own long, node long, prefix array<smallint>"
    return gathered(rows).select(*[c.split()[0] for c in kept.split(", ")]).mapInPandas(run, kept)


def verified(entries: DataFrame, index: Index, threshold: float) -> DataFrame:
    """Links in each list: node, links (rows linked to it there), root (the smallest node of its component there).

    entries: retrieved() with n and vector of each node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.whole_groups(frames, LIST, rows=4000):
            n, node = frame["n"].to_numpy(), frame["node"].to_numpy()
            links, left, right = np.zeros(len(frame), dtype=np.int64), [], []
            # lists may hold vectors of one width only, a frame those of several
            x, width = frame["vector"].to_numpy(), frame["vector"].str.len().to_numpy() // 8
            for a, b, mask in candidates(frame, index):
                if mask is None:
                    good = np.empty(len(a), dtype=bool)
                    for w in np.unique(width[a]):
                        mine = np.flatnonzero(width[a] == w)
                        for k in range(0, len(mine), 20_000):
                            m = mine[k : k + 20_000]
                            good[m] = np.einsum("ij,ij->i", _rows(x[a[m]], w), _rows(x[b[m]], w)) >= threshold
                    a, b = a[good], b[good]
                else:
                    linked = np.zeros(mask.shape, dtype=bool)
                    u, v = _rows(x[a], width[a[0]]), _rows(x[b], width[a[0]])
                    for k in range(0, len(a), 256):
                        linked[k : k + 256] = mask[k : k + 256] & (u[k : k + 256] @ v.T >= threshold)
                    links[a] += linked @ n[b]
                    links[b] += n[a] @ linked
                    a, b = _spanning(linked, a, b)
                    left.append(a)
                    right.append(b)
                    continue
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                left.append(a)
                right.append(b)
            label = common.local_components(len(frame), np.concatenate([*left, []]).astype(np.int64), np.concatenate([*right, []]).astype(np.int64))
            some = links > 0
            yield pd.DataFrame({"node": node[some], "links": links[some], "root": node[label[some]]})

    return entries.mapInPandas(run, "node long, links long, root long")


def _rows(values: np.ndarray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), width)


def _spanning(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of links between rows a and b as few links: of each component's rows to one of them."""
    left, right = [], []
    open_a, open_b = linked.any(axis=1), linked.any(axis=0)
    while open_a.any():
        start = now = np.flatnonzero(open_a)[:1]
        open_a[start] = False
        while len(now):
            reached = np.flatnonzero(open_b & linked[now].any(axis=0))
            open_b[reached] = False
            now = np.flatnonzero(open_a & linked[:, reached].any(axis=1))
            open_a[now] = False
            right += [b[reached], a[now]]
        left.append(np.repeat(a[start], sum(map(len, right)) - sum(map(len, left))))
    whole = lambda x: np.concatenate([*x, []]).astype(np.int64)
    return whole(left), whole(right)


def near_embeddings(rows: DataFrame, threshold: float = 0.93, index: Index = Index()) -> DataFrame:
    """Links and groups of vectors of one label at a cosine of `threshold` or more.

    rows: vec_id, label, embedding (an array of numbers); other columns are ignored. Returns for each row vec_id, n_links
    (other rows linked directly), component_id (the smallest vec_id reachable by links, its own included) and kept (vec_id =
    component_id). Rows with a null label or vec_id, and vectors that are null, empty, zero or hold null or non-finite entries,
    link with nothing; without a vec_id component_id is null and kept true. Vectors of different widths don't link. Rows that
    repeat a vec_id are rows of their own: they link, or not, by their vectors, and count as others. An empty table gives no rows."""
    spark = rows.sparkSession
    common.small_batches(spark)
    nonzero = F.exists("embedding", lambda x: x != 0)
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & vectors.usable("embedding") & (F.size("embedding") > 0) & F.coalesce(nonzero, F.lit(False))
    all_ = rows.select(F.col("vec_id").cast("long"), ok.alias("ok"), F.xxhash64("label", F.size("embedding")).alias("place"), F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2"), "embedding")
    good = all_.where("ok")
    nodes = nodes_of(good, index)
    entries = common.materialize(retrieved(blocked(lists(nodes, index)), index), "candidates")
    full = gathered(entries.join(nodes.select("node", "n", "vector"), "node")).select(*LIST, "own", "node", "prefix", "n", "vector")
    found = common.materialize(verified(full, index, threshold), "links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    mine = nodes.select("place", "h1", "h2", "node", "first", "n").join(degree, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mine = common.materialize(mine, "members")
    lowest = common.materialize(mine.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "lowest")
    named = common.spread_join(mine, lowest, ["component"], "size")
    # equal vectors are one node: its rows are linked with one another too
    named = common.materialize(named.select("place", "h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    ids = common.materialize(all_.drop("embedding"), "ids")
    out = common.spread_join(ids.where("ok"), named, ["place", "h1", "h2"], "n").select("vec_id", "n_links", "component_id")
    out = out.unionByName(ids.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at cosine 0.93."""
    return near_embeddings(common.table(spark, sf_dir, "embeddings"))
