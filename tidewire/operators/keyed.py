"""Keyed tables in Parquet that are updated in part and read at a version.

A table is split into parts by its key. An update reads and writes only the parts that its rows fall into; a version is a small
manifest that says in which folder each part lies. The manifest is created last and only if no other writer has made that
version meanwhile, so readers see all of an update or nothing, a writer that dies leaves the table as it was, and two
writers never lose each other's rows. A reader of a version goes on seeing it while newer ones are written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Groups of channels, and message ids that lie in one part: new posts of a channel touch its last parts only.
CHANNELS, IDS = 64, 10_000


def by_post() -> Column:
    """Part of a post by (group_id, channel, message_id): near ids of a channel share one."""
    return F.pmod(F.xxhash64("group_id", "channel"), F.lit(CHANNELS)) * 1_000_000_000 + F.floor(F.col("message_id") / IDS).cast("long")


class Conflict(Exception):
    """Another writer has made the version first."""


class KeyedTable:
    """A table at a path of a shared file system. part: a long, by columns of the key."""

    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, part: Column):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The latest version; 0 before the first write."""
        folder = self._path(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int) -> dict:
        """parts: folder by part; done: the last batch of each stream that is in the table."""
        if not version:
            return {"parts": {}, "done": {}}
        stream = self._fs.open(self._path(f"{self.path}/_manifests/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows of a version (the latest by default), or of some of its parts."""
        held = self.manifest(self.version() if version is None else version)["parts"]
        chosen = held if parts is None else {str(p): held[str(p)] for p in parts if str(p) in held}
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}/_part={p}" for p, folder in sorted(chosen.items())])

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, batch: int = 0) -> int:
        """Replace the touched parts by how(old, rows); returns the version that holds the result.

        old has the rows of the parts that `rows` fall into, which are all that share a key with them; what how() returns must
        stay in these parts. stream and batch: a batch of a stream that is in the table already isn't merged again."""
        for _ in range(self.ATTEMPTS):
            now = self.version()
            held = self.manifest(now)
            if stream is not None and held["done"].get(stream, -1) >= batch:
                return now
            parts = [r[0] for r in rows.select(self.part).distinct().collect()]  # parts that one update touches
            merged = how(self.read(now, parts), rows).select(*self.schema.names).withColumn("_part", self.part)
            folder = f"data/{now + 1}-{uuid.uuid4().hex}"
            merged.repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
            written = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
            mine = {n.removeprefix("_part="): folder for n in written if n.startswith("_part=")}
            rest = {p: f for p, f in held["parts"].items() if int(p) not in set(parts)}
            try:
                self._commit(now + 1, {"parts": rest | mine, "done": held["done"] | ({stream: batch} if stream is not None else {})})
            except Conflict:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
                continue
            return now + 1
        raise Conflict(f"{self.ATTEMPTS} attempts to write {self.path}")

    def _commit(self, version: int, manifest: dict) -> None:
        """Create a manifest, in one step and only where there is none: written under another name, then renamed."""
        final, draft = self._path(f"{self.path}/_manifests/{version}.json"), self._path(f"{self.path}/_manifests/{uuid.uuid4().hex}.part")
        stream = self._fs.create(draft)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        try:
            # as Hadoop's file contexts have it, a rename onto a file that exists fails
            none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), none)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(draft, False)
            raise Conflict(str(version)) from e

    def forget(self, keep: int = 1) -> int:
        """Delete manifests older than the last `keep` versions and the folders that only they, or no one, refer to; returns
        how many folders. Not while a write is going on, whose folder no manifest has yet."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        used = {f.removeprefix("data/") for v in kept for f in self.manifest(v)["parts"].values()}
        for v in range(kept[0] - 1 if kept else 0, 0, -1):
            old = self._path(f"{self.path}/_manifests/{v}.json")
            if not self._fs.exists(old):
                break
            self._fs.delete(old, False)
        data = self._path(f"{self.path}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in used] if self._fs.exists(data) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
