"""The history of channels as a stream: newest page first, then older ones, each page once.

A channel's cursor says which spans of ids are still to be read. A round reads up to `pages` pages of every channel, one task
a channel, from the newest span on; a poll adds the span above the largest id read so far, so that posts which came
meanwhile are read down to the known ones, and the older history goes on where it stopped.

Cursors are small files in a shared folder, one a channel and round, written by the task that read the pages. The stream's offset
is the number of the round. A batch that runs again reads the cursors of the round before it, so it reads the same spans; a
restarted query goes on behind the last finished round.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .pages import POST, parse_page

#: Limits of the page budget of a round.
PAGES_LEAST, PAGES_MOST = 1, 50


@dataclass(frozen=True)
class Cursor:
    """spans: (before, floor), newest first: ids below `before` (None: from the newest) and above `floor` are unread.

    top: the largest id read; stuck: the last page couldn't be had, so the channel waits for the next poll."""

    spans: tuple[tuple[int | None, int], ...] = ((None, 0),)
    top: int = 0
    stuck: bool = False

    @property
    def open(self) -> bool:
        return bool(self.spans) and not self.stuck

    def polled(self) -> Cursor:
        """With the span above everything read so far, unless it is there already."""
        newest = self.spans and self.spans[0][0] is None
        return replace(self, spans=self.spans if newest else ((None, self.top), *self.spans), stuck=False)

    def read(self, fetch: Callable[[int | None], str | None], parse: Callable[[str], list[tuple]], pages: int, most_new: int | None = None) -> tuple[list[tuple], Cursor]:
        """Posts of up to `pages` pages, and the cursor after them. After `most_new` posts no further page is begun; a
        page that was begun counts in whole, as it isn't read again."""
        found: list[tuple] = []
        spans, top = list(self.spans), self.top
        for _ in range(min(PAGES_MOST, max(PAGES_LEAST, pages))):
            if not spans or (most_new is not None and len(found) >= most_new):
                break
            before, floor = spans[0]
            html = fetch(before)
            if html is None:
                return found, Cursor(tuple(spans), top, True)
            page = {p[1]: p for p in parse(html)}
            new = sorted((i for i in page if i > floor and (before is None or i < before)), reverse=True)
            found += [page[i] for i in new]
            top = max([top, *new])
            oldest = min(page, default=floor)
            # an empty page, one that leads no further, or one that reaches the floor ends the span
            if not page or oldest <= floor + 1 or (before is not None and oldest >= before):
                spans.pop(0)
            else:
                spans[0] = (oldest, floor)
        return found, Cursor(tuple(spans), top)

    def text(self) -> str:
        return json.dumps({"spans": self.spans, "top": self.top, "stuck": self.stuck})

    @staticmethod
    def of(text: str) -> Cursor:
        d = json.loads(text)
        return Cursor(tuple((b, f) for b, f in d["spans"]), d["top"], d["stuck"])


class Cursors:
    """The files of cursors in a folder: <folder>/<channel>/<round>.json, each written in one step."""

    def __init__(self, folder: str):
        self.folder = folder

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def rounds(self, channel: str) -> list[int]:
        system, path = self._at()
        files = system.get_file_info(fs.FileSelector(f"{path}/{channel}", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in files if f.base_name.endswith(".json"))

    def load(self, channel: str, number: int) -> Cursor:
        """The cursor after a round; a channel that wasn't read by then starts anew."""
        system, path = self._at()
        file = f"{path}/{channel}/{number}.json"
        if number <= 0 or system.get_file_info(file).type == fs.FileType.NotFound:
            return Cursor()
        with system.open_input_stream(file) as f:
            return Cursor.of(f.read().decode())

    def save(self, channel: str, number: int, cursor: Cursor) -> None:
        system, path = self._at()
        system.create_dir(f"{path}/{channel}", recursive=True)
        with system.open_output_stream(f"{path}/{channel}/{number}.part") as f:
            f.write(cursor.text().encode())
        system.move(f"{path}/{channel}/{number}.part", f"{path}/{channel}/{number}.json")

    def drop(self, channel: str, below: int) -> None:
        system, path = self._at()
        for n in self.rounds(channel):
            if n < below:
                system.delete_file(f"{path}/{channel}/{n}.json")


@dataclass
class _Share(InputPartition):
    channel: str
    number: int


class ChannelHistory(DataSource):
    """Spark stream source 'channel_history'; its rows are posts (pages.POST).

    Options: channels (comma-separated), fetcher ('module:factory' of a PageFetcher, called on the executors, with `argument` if that is given), state (a shared
    folder for the cursors, which belongs to the query's checkpoint), pages (budget of a round and channel, 1 to 50; default
    5), most_new (posts of a round and channel after which no further page is begun) and poll ('true': every batch looks
    for newer posts; otherwise the stream rests once the history is read)."""

    @classmethod
    def name(cls) -> str:
        return "channel_history"

    def schema(self) -> str:
        return POST

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _HistoryReader(dict(self.options))


class _HistoryReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.channels = list(dict.fromkeys(c.strip().lower().lstrip("@") for c in given["channels"].split(",") if c.strip()))
        self.fetcher, self.pages, self.poll = given["fetcher"], int(given.get("pages", 5)), given.get("poll", "false").lower() == "true"
        self.most_new = int(given["most_new"]) if given.get("most_new") else None
        self.cursors, self.arguments = Cursors(given["state"]), [given["argument"]] if "argument" in given else []

    def initialOffset(self) -> dict:
        return {"round": 0}

    def _done(self) -> int:
        """The last round that every channel of it has ended."""
        last = [max(r) for r in map(self.cursors.rounds, self.channels) if r]
        return min(last, default=0)

    def latestOffset(self) -> dict:
        done = self._done()
        more = self.poll or any(self.cursors.load(c, done).open for c in self.channels)
        return {"round": done + 1 if more else done}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # channels without unread pages have a share as well: their cursors are carried on
        return [_Share(c, end["round"]) for c in self.channels] if end["round"] > start["round"] else []

    def read(self, partition: _Share) -> Iterator[tuple]:
        module, _, factory = self.fetcher.partition(":")
        cursor = self.cursors.load(partition.channel, partition.number - 1)
        cursor = cursor.polled() if self.poll else cursor
        found = []
        if cursor.open:
            fetcher = getattr(importlib.import_module(module), factory)(*self.arguments)
            found, cursor = cursor.read(lambda before: fetcher.fetch(partition.channel, before), lambda html: parse_page(html, partition.channel), self.pages, self.most_new)
        yield from found
        self.cursors.save(partition.channel, partition.number, cursor)

    def commit(self, end: dict) -> None:
        for c in self.channels:
            self.cursors.drop(c, end["round"] - 1)
