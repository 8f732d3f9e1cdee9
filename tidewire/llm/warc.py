"""WARC archives with revisit records, and a globally ordered capture index by external merge.

Writing. Every scan partition writes its pages to archives of bounded size (one gzip member a record).
Of pages with equal payloads the one with the largest page_id is a response, the others are revisit
records that refer to it. Files get names of their own for each task attempt and are moved into place
when complete; only files that a committed attempt lists are read, so a task may run again at any time.

Reading back. Payload lengths and digests are those of the bytes read, not of headers; a revisit's are those of the
response that it refers to. A record that isn't intact, one that the index doesn't list, and a listed one that isn't
there stop the job.

Index. While it writes, a task collects its captures and flushes them as locally sorted runs of bounded
length, with the key at the start of every block of `BLOCK` lines. Merge ranges are cut from these keys;
each range merges the slices of all runs with a loser tree, which streams and holds one block of each
run. With more than `FAN_IN` runs, passes that merge `FAN_IN` runs into one come first. Ranges are cut by
URL key, timestamp and position, so that one hot URL is spread over several ranges.

Files go to and come from the shared folder through pyarrow's file systems, which take s3a:// and s3n:// as s3://; a
scheme that they don't know is an error.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES, RUN_CAPTURES, BLOCK, FAN_IN, RANGE_CAPTURES = 64 << 20, 50_000, 1000, 128, 200_000
#: Merge ranges at most; with more captures than RANGES * RANGE_CAPTURES ranges get longer (a merge streams, so it needs no more memory).
RANGES = 4096
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

MANIFEST = "kind string, path string, block long, key string, next_key string, start long, stop long, captures long"
RECORD = "archive string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, named_digest string, intact boolean"
CAPTURE = "urlkey string, timestamp string, page_id long, record_type string, payload_digest string, archive string, offset long, length long"


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: reversed host, path, sorted query, without scheme, www. and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return _clean(url or "").lower()
    if not host:
        return _clean(url or "").lower()
    port_text = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return _clean(",".join(reversed(host.split("."))) + port_text + ")" + (parts.path.rstrip("/") or "/") + query).lower()


def _clean(s: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in s)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def moment(page_id: int | None) -> datetime.datetime:
    """The capture time of a page; the table has none, so one is made from the id."""
    return EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {moment(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class _Writer:
    """Archives and index runs of one task attempt."""

    def __init__(self, out: str, archive_bytes: int, run_captures: int):
        context = TaskContext.get()
        self.name = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        self.out, self.archive_bytes, self.run_captures = out, archive_bytes, run_captures
        self.fs, self.root = open_fs(out)
        self.n = 0
        self.stream = None
        self.captures: list[tuple] = []
        self.rows: list[tuple] = []

    def _open(self) -> None:
        self.archive = f"{self.root}/{self.name}-{self.n:05d}.warc.gz"
        self.stream, self.size, self.count = self.fs.open_output_stream(self.archive + ".part", compression=None), 0, 0
        self.n += 1

    def _close(self) -> None:
        if self.stream:
            self.stream.close()
            self.fs.move(self.archive + ".part", self.archive)
            self.rows.append(("archive", self.archive, 0, None, None, 0, self.size, self.count))
            self.stream = None

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        if self.stream is None:
            self._open()
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        raw = pack.compress(record(page_id, url, payload, refers_to)) + pack.flush()
        self.stream.write(raw)
        kind = "response" if refers_to is None else "revisit"
        self.captures.append((surt(url), f"{moment(page_id):%Y%m%d%H%M%S}", "" if page_id is None else f"{page_id:020d}", kind, digest(payload), self.archive, str(self.size), str(len(raw))))
        self.size += len(raw)
        self.count += 1
        if self.size >= self.archive_bytes:
            self._close()
        if len(self.captures) >= self.run_captures:
            self.flush()

    def flush(self) -> None:
        self.captures.sort()
        if self.captures:
            self.rows += write_run(self.fs, f"{self.root}/{self.name}-{self.n:05d}-{uuid.uuid4().hex[:8]}.run", (sort_key(c) + "\n" for c in self.captures))
        self.captures = []

    def end(self) -> list[tuple]:
        self.flush()
        self._close()
        return self.rows


def sort_key(capture: tuple) -> str:
    """A capture as a line that sorts like its fields."""
    return "\t".join(capture)


def write_run(fs, path: str, lines: Iterator[str]) -> list[tuple]:
    """Write sorted lines; manifest rows of the run's blocks."""
    starts, keys, at, n = [], [], 0, 0
    with fs.open_output_stream(path + ".part", compression=None) as out:
        held = []
        for line in lines:
            if n % BLOCK == 0:
                starts.append(at)
                keys.append(line[:-1])
            raw = line.encode("utf-8", "surrogatepass")
            held.append(raw)
            at += len(raw)
            n += 1
            if len(held) >= BLOCK:
                out.write(b"".join(held))
                held = []
        out.write(b"".join(held))
    fs.move(path + ".part", path)
    return [("run", path, k, keys[k], keys[k + 1] if k + 1 < len(keys) else None, starts[k], starts[k + 1] if k + 1 < len(starts) else at, min(BLOCK, n - k * BLOCK)) for k in range(len(starts))]


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id and digest of the pages to write as revisits, and the page they refer to.

    Payloads shorter than least_bytes have none. Rows are told apart by page_id."""
    sized = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull())
    firsts = sized.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return sized.drop("n").join(firsts, "sha1").where("page_id <> refers_to").select(F.col("page_id").alias("r_page"), F.col("sha1").alias("r_sha1"), "refers_to").distinct()


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, run_captures: int = RUN_CAPTURES) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html); the manifest of archives and index runs.

    A null html is an empty payload, a null url an empty one. Rows with a null page_id are responses.
    Rows that repeat the largest page_id of a payload are all responses."""
    spark = pages.sparkSession
    common.small_batches(spark)
    again = common.materialize(revisits(pages, least_bytes), "revisits")  # its size is known now: the join needn't shuffle payloads if it is small
    typed = pages.select(F.col("page_id").cast("long"), "url", "html")
    joined = typed.join(again, (F.col("page_id") == F.col("r_page")) & (F.sha1(F.coalesce("html", F.lit(""))) == F.col("r_sha1")), "left").select("page_id", "url", "html", "refers_to")
    arrow_root, path = open_fs(out)
    arrow_root.create_dir(path, recursive=True)

    def run(batches) -> Iterator[pd.DataFrame]:
        writer = _Writer(out, archive_bytes, run_captures)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
        yield from _arrow(writer.end(), MANIFEST)

    return common.materialize(joined.mapInArrow(run, MANIFEST), "manifest")


def _arrow(rows: list[tuple], ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])
    yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema=schema)


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream."""
    at, used, unpack, out, rest = 0, 0, zlib.decompressobj(31), [], b""
    while True:
        chunk = rest or stream.read(1 << 20)
        if not chunk:
            return
        out.append(unpack.decompress(chunk))
        rest = unpack.unused_data
        used += len(chunk) - len(rest)
        if unpack.eof:
            yield at, used, b"".join(out)
            at, used, unpack, out = at + used, 0, zlib.decompressobj(31), []


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """Every record of the listed archives (RECORD). payload_bytes and payload_digest are of the payload read (null for a
    revisit, which has none), named_digest is the header's; intact: the payload has the length and digest of the headers."""
    spark = manifest.sparkSession
    files = manifest.where("kind = 'archive'").select("path")
    n = max(1, files.count())

    def run(batches):
        fs, _ = open_fs(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, length, raw in members(stream):
                        fields, payload = parse(raw)
                        number = lambda k: int(fields[k]) if fields.get(k) else None  # noqa: B023, E731
                        named, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        size, sha = (None, None) if kind == "revisit" else (len(payload), digest(payload))
                        intact = not payload if kind == "revisit" else (size, sha) == (number("x-payload-length"), named)
                        rows.append((path, offset, length, number("x-page-id"), fields.get("warc-target-uri"), kind, number("x-refers-to-page"), size, sha, named, intact))
                        if len(rows) >= 1000:
                            yield from _arrow(rows, RECORD)
                            rows = []
                yield from _arrow(rows, RECORD)

    return files.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, RECORD)


class LoserTree:
    """Merges k sorted iterators: each step replays one path of the tree, log2(k) comparisons."""

    def __init__(self, streams: list[Iterator[str]]):
        self.streams = streams
        self.k = len(streams)
        self.heads = [next(s, None) for s in streams]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i, True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return (y is None and (x is not None or a < b)) or (x is not None and y is not None and (x, a) < (y, b))

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[str]:
        while self.k and (top := self.heads[w := self.losers[0]]) is not None:
            yield top
            self.heads[w] = next(self.streams[w], None)
            self._play(w)


def slice_lines(fs, path: str, start: int, stop: int, low: str | None, high: str | None) -> Iterator[str]:
    """Lines of a run's bytes from start to stop whose key is at least low and below high; a block is held at a time."""
    with fs.open_input_file(path) as f:
        rest = b""
        while start < stop:
            got = f.read_at(min(1 << 17, stop - start), start)
            start += len(got)
            lines = (rest + got).split(b"\n")
            rest = lines.pop()
            for raw in lines:
                line = raw.decode("utf-8", "surrogatepass")
                if high is not None and line >= high:
                    return
                if low is None or line >= low:
                    yield line


def compact(manifest: DataFrame, root: str, fan_in: int = FAN_IN) -> DataFrame:
    """Merge at most fan_in runs at a time until at most fan_in are left; the new runs' manifest."""
    runs = manifest.where("kind = 'run'")
    while (n := runs.select("path").distinct().count()) > fan_in:
        dealt = runs.groupBy("path").agg(F.max("stop").alias("stop")).withColumn("deal", F.pmod(F.xxhash64("path"), F.lit(-(-n // fan_in))))
        # a hash deals unevenly: what is beyond fan_in in a deal is a part of its own
        over = F.floor((F.row_number().over(Window.partitionBy("deal").orderBy("path")) - 1) / fan_in)
        spans = dealt.withColumn("part", F.col("deal") + over * (-(-n // fan_in))).drop("deal")

        def run(frames: Iterator[pd.DataFrame]):
            fs, base = open_fs(root)
            for frame in common.whole_groups(frames, ["part"], rows=1):
                cuts = common.group_bounds(frame, ["part"])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    some = frame.iloc[a:b]
                    tree = LoserTree([slice_lines(fs, p, 0, int(e), None, None) for p, e in zip(some["path"], some["stop"], strict=True)])
                    rows = write_run(fs, f"{base}/merged-{uuid.uuid4().hex}.run", (x + "\n" for x in tree))
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in MANIFEST.split(", ")])

        runs = common.materialize(spans.repartition("part").sortWithinPartitions("part", "path").mapInPandas(run, MANIFEST), "runs")
    return runs


def capture_index(manifest: DataFrame, root: str, range_captures: int = RANGE_CAPTURES, fan_in: int = FAN_IN) -> DataFrame:
    """All captures in order of URL key, timestamp and page_id: columns part, rank (from 0, as merged), and CAPTURE.

    Parts are disjoint ranges in order of their number."""
    runs = compact(manifest, root, fan_in)
    total = runs.agg(F.sum("captures")).first()[0] or 0
    parts = min(RANGES, max(1, -(-total // range_captures)))
    edges: list[str] = []
    if parts > 1:  # one bound for each range
        placed = runs.select("key").repartitionByRange(int(parts), "key").select("key", F.spark_partition_id().alias("p"))
        edges = sorted(r[0] for r in placed.groupBy("p").agg(F.min("key")).select("min(key)").collect())[1:]
    ddl = "part long, path string, start long, stop long, low string, high string"

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = np.array(edges, dtype=object)
        for f in frames:
            rows = []
            for path, key, after, start, stop in zip(f["path"], f["key"], f["next_key"], f["start"], f["stop"], strict=True):
                first = int(np.searchsorted(bounds, key, side="right"))
                last = int(np.searchsorted(bounds, after, side="right")) if after is not None else len(edges)
                rows += [(p, path, start, stop, edges[p - 1] if p else None, edges[p] if p < len(edges) else None) for p in range(first, last + 1)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ddl.split(", ")])

    slices = runs.mapInPandas(deal, ddl).groupBy("part", "path", "low", "high").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_fs(root)
        names = ["part", "rank"] + [x.split()[0] for x in CAPTURE.split(", ")]
        for frame in common.whole_groups(frames, ["part"], rows=1):
            cuts = common.group_bounds(frame, ["part"])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = frame.iloc[a:b]
                tree = LoserTree([slice_lines(fs, r.path, int(r.start), int(r.stop), r.low, r.high) for r in some.itertuples()])
                rows = []
                for rank, line in enumerate(tree):
                    key, time, page, kind, sha, archive, offset, length = line.split("\t")
                    rows.append((int(some["part"].iloc[0]), rank, key, time, int(page) if page else None, kind, sha, archive, int(offset), int(length)))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return slices.repartition("part").sortWithinPartitions("part", "path").mapInPandas(merge, "part long, rank long, " + CAPTURE)


def placed(index: DataFrame) -> DataFrame:
    """The index with each capture's place in the order of all captures (position, from 0): those of the parts before it, and its rank."""
    counts = index.groupBy("part").agg(F.count("*").alias("n"))  # RANGES rows at most, so one task may add them up
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("rank")).drop("before")


def checked(index: DataFrame, records: DataFrame) -> DataFrame:
    """A row for each capture: what its record holds, with urlkey and position of the index.

    Payload facts of a revisit are those of its response. Anything missing or broken stops the job. Both tables should be
    written ones."""
    i = index.select("urlkey", "position", F.col("archive").alias("i_archive"), F.col("offset").alias("i_offset"))
    # offsets compress so well that adaptive execution would take the index for small and broadcast it
    both = i.hint("merge").join(records, (F.col("i_archive") == F.col("archive")) & (F.col("i_offset") == F.col("offset")), "full")
    fault = F.when(F.col("i_archive").isNull(), "is not in the index").when(F.col("archive").isNull(), "is not in the archives").when(~F.col("intact"), "is not intact")
    stop = lambda bad, why, value: F.when(bad, F.raise_error(F.concat(F.lit("WARC: a record "), why))).otherwise(value)
    both = both.withColumn("record_type", stop(fault.isNotNull(), fault, F.col("record_type")))
    both = common.materialize(both.select("page_id", "payload_bytes", "payload_digest", "named_digest", "record_type", "refers_to", "urlkey", "position"), "captures")
    key = ["refers_to", "named_digest"]
    again = both.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    first = both.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("named_digest"), "payload_bytes").distinct()
    facts = again.groupBy(*key).agg(F.count("*").alias("n")).join(first, key, "left")
    facts = facts.withColumn("payload_bytes", stop(F.col("payload_bytes").isNull(), F.lit("refers to a response that is not there"), F.col("payload_bytes")))
    found = common.spread_join(again, common.materialize(facts, "responses"), key, "n").withColumn("payload_digest", F.col("named_digest"))
    return both.where("record_type = 'response'").unionByName(found).drop("named_digest")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page, read back from archives by way of the merged index: also its URL key and its place in the capture order."""
    root = common.new_path(spark, "archives")
    manifest = write_archives(common.table(spark, sf_dir, "pages"), root)
    index = common.materialize(capture_index(manifest, root), "index")
    return checked(placed(index), common.materialize(read_archives(manifest, root), "records"))


OP8_SQL = r"""
WITH hashed AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), nibbles AS (
  SELECT page_id, url, octet_length(encode(payload)) AS n, hex, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(hex, i, 1)) - 1) AS d FROM hashed
), digits AS (
  SELECT page_id, url, n, array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((d[5*k+1] * 65536 + d[5*k+2] * 4096 + d[5*k+3] * 256 + d[5*k+4] * 16 + d[5*k+5])) >> s) & 31)::INT + 1, 1)), '')), '') AS digest,
    regexp_extract(url, '^(https?)://(?:www\.)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS u
  FROM nibbles
), keyed AS (
  SELECT *, lower(array_to_string(list_reverse(string_split(u.host, '.')), ',') || ')' || CASE WHEN rtrim(u.path, '/') = '' THEN '/' ELSE rtrim(u.path, '/') END
    || CASE WHEN u.query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(u.query, '&')), '&') END) AS urlkey FROM digits
), tops AS (SELECT digest, max(page_id) AS top FROM digits GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, urlkey,
  row_number() OVER (ORDER BY urlkey || chr(9) || strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') || chr(9) || lpad(CAST(page_id AS VARCHAR), 20, '0')) - 1 AS position
FROM keyed JOIN tops USING (digest)
"""
