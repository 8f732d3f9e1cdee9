"""Helpers shared by the training-data operators: tables, cut lineage, grouped streams, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; with very long texts this keeps a batch within memory.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, read by Spark so that any path Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id and text aren't in bad (doc_id, copy: a hash of the text)."""
    k, c = fresh(docs, "bad_id"), fresh(docs, "bad_copy")
    gone = bad.select(F.col("doc_id").alias(k), F.col("copy").alias(c)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(k)) & (F.xxhash64(docs["text"]) == F.col(c)), "left_anti")


_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir, or a temporary one of ours where it is unset, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidewire-"))
        base = _own_dir[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/tidewire-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of new_path() through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder belongs to the cluster then
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this share of the rows is joined by a broadcast of its own: at most as many keys as the inverse.
HOT_SHARE = 1 / 512


def spread_join(left: DataFrame, right: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key and in `count` the key's rows on the left.

    Keys beyond HOT_SHARE of the left rows (so 512 of them at most) are broadcast, which leaves their rows where they
    are; the other keys are small beside a task and go by a shuffle. Both tables should be written ones. `count` isn't kept."""
    most = max(1, int(left.count() * HOT_SHARE))
    hot, rest = (right.where(F.col(count) > most).drop(count), right.where(F.col(count) <= most).drop(count))
    by_hot = left.join(F.broadcast(hot), key, how)
    others = left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, how)
    return by_hot.unionByName(others)


def salted_join(left: DataFrame, right: DataFrame, key: list[str], salts: int = 16) -> DataFrame:
    """An inner join in which keys beyond HOT_SHARE of the left rows (512 of them at most) are dealt to `salts` tasks.

    The right side's rows of these keys are repeated for each salt. The left table is read twice."""
    counts = left.groupBy(*key).agg(F.count("*").alias("n"))
    mark, salt = fresh(left, "join_mark"), fresh(left, "join_salt")
    most = max(1, int(left.count() * HOT_SHARE))
    hot = [r[0] for r in counts.where(F.col("n") > most).select(F.xxhash64(*key)).collect()]  # at most 1 / HOT_SHARE
    if not hot:
        return left.join(right, key)
    spread = F.when(F.xxhash64(*key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    # a row's salt comes from its content, so that a task that runs again deals its rows the same way
    lifted = left.withColumn(mark, spread).withColumn(salt, F.element_at(mark, F.pmod(F.xxhash64(F.lit(3), *left.columns), F.size(mark)).cast("int") + 1)).drop(mark)
    return lifted.join(right.withColumn(salt, F.explode(spread)), [*key, salt]).drop(salt)


def whole_groups(frames: Iterator[pd.DataFrame], key: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """From frames sorted by key, frames of about `rows` rows that never cut a group in two."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        if frame.empty:
            continue
        held.append(frame)
        n += len(frame)
        if n < rows:
            continue
        joined = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        last = np.ones(len(joined), dtype=bool)
        for k in key:
            last &= joined[k].to_numpy() == joined[k].iloc[-1]
        start = len(joined) - int(last[::-1].argmin() if not last.all() else len(joined))
        if start:
            yield joined.iloc[:start]
        held = [joined.iloc[start:]]
        n = len(held[0])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def group_bounds(frame: pd.DataFrame, key: list[str]) -> np.ndarray:
    """Where groups of a sorted frame begin, and its length last."""
    new = np.zeros(len(frame), dtype=bool)
    if len(frame):
        new[0] = True
    for k in key:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node that each one reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): (node, component) with the component's smallest node.

    Alternates large-star and small-star steps, which take a logarithmic number of rounds; every round
    aggregates before it shuffles and is written to the shared folder. Only nodes that have a link to
    another node are returned; self links are ignored. Null ends are ignored.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        if not now[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "links")
    tops = edges.select("v").distinct()
    return materialize(
        edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(tops.select(F.col("v").alias("node"), F.col("v").alias("component"))),
        "components",
    )
