"""Channel pages: fetch interface, HTML parser, history walk and a Spark data source.

The parser is built on the standard library's event parser and keeps one open message at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.timewin import iso_instant

POST = "channel string, message_id long, published string, text string, has_media boolean, media_type string, media_urls array<string>, direct_url string, forward_from string, views string"
# --- fixed values: class names of a message's parts ---
MESSAGE, TEXT, SERVICE = "tgme_widget_message", "tgme_widget_message_text", ("tgme_widget_message_service", "service_message")
FORWARD, VIEWS, PHOTO = "tgme_widget_message_forwarded_from_name", "tgme_widget_message_views", "tgme_widget_message_photo_wrap"
VIDEO, DOCUMENT, POLL = ("tgme_widget_message_video", "tgme_widget_message_video_player"), "tgme_widget_message_document", "tgme_widget_message_poll"
_IMAGE = re.compile(r"background-image:\s*url\(['\"]?([^'\")]+)['\"]?\)")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class PageFetcher(Protocol):
    """Anything that gets a channel's page, or None where there is none."""

    def fetch(self, channel: str, before: int | None = None) -> str | None: ...


@dataclass
class _Message:
    depth: int
    data_post: str
    skipped: bool
    time: str | None = None
    text: list[str] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)
    forward: list[str] | None = None
    views: list[str] | None = None
    photos: list[str | None] = field(default_factory=list)
    kinds: set[str] = field(default_factory=set)
    video_src: str | None = None


class _Parser(HTMLParser):
    def __init__(self, default_channel: str | None):
        super().__init__(convert_charrefs=True)
        self.default, self.posts, self.stack = default_channel, [], []
        self.message: _Message | None = None
        self.sink: tuple[str, int] | None = None  # part being read, and its depth
        self.link: tuple[str, list[str]] | None = None

    @property
    def depth(self) -> int:
        return len(self.stack)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = set(a.get("class", "").split())
        if tag not in _VOID:
            self.stack.append(tag)
        if MESSAGE in names:
            self._end_message()
            self.message = _Message(self.depth, a.get("data-post", ""), any(c in names for c in SERVICE))
        m = self.message
        if m is None:
            return
        if tag == "time" and m.time is None and a.get("datetime"):
            m.time = a["datetime"].strip()
        if tag == "br" and self.sink and self.sink[0] == "text":
            self._data("\n")
        if tag == "a" and self.sink and self.sink[0] == "text" and self.link is None:
            self.link = (a.get("href", "").strip(), [])
        if PHOTO in names:
            found = _IMAGE.search(a.get("style", ""))
            m.photos.append(found[1] if found else None)
        if tag == "video" or any(c in names for c in VIDEO):
            if "video" not in m.kinds:
                m.video_src = a.get("src") or None
            m.kinds.add("video")
        for name, kind in ((DOCUMENT, "document"), (POLL, "poll")):
            if name in names:
                m.kinds.add(kind)
        for name, part in ((TEXT, "text"), (FORWARD, "forward"), (VIEWS, "views")):
            if name in names and self.sink is None and part not in m.seen:
                m.seen.add(part)
                self.sink = (part, self.depth)
                if part != "text":
                    setattr(m, part, [])

    def handle_endtag(self, tag):
        if tag in _VOID or tag not in self.stack:
            return
        if tag == "a" and self.link is not None:
            self._end_link()
        while self.stack.pop() != tag:  # tags left open inside end here too
            pass
        if self.sink and self.depth < self.sink[1]:
            self._end_link()
            self.sink = None
        if self.message and self.depth < self.message.depth:
            self._end_message()

    def handle_data(self, data):
        if self.message and self.sink:
            self._data(data)

    def _data(self, s: str) -> None:
        part = self.sink[0]
        if part == "text":
            (self.link[1] if self.link else self.message.text).append(s)
        else:
            getattr(self.message, part).append(s)

    def _end_link(self) -> None:
        if self.link is None:
            return
        (href, parts), self.link = self.link, None
        raw = "".join(parts)
        shown = raw.strip()
        if href and shown:
            raw = href if href == shown else shown if shown.startswith("@") else f"[{shown}]({href})"
        if self.message:
            self.message.text.append(raw)

    def _end_message(self) -> None:
        self._end_link()
        m, self.message, self.sink = self.message, None, None
        if m is None or m.skipped or "/" not in m.data_post:
            return
        slug, _, number = m.data_post.partition("/")
        channel = (slug or self.default or "").lower().lstrip("@")
        try:
            message_id = int(number)
        except ValueError:
            return
        if not channel:
            return
        text = tidy("".join(m.text))
        kind = next((k for k in ("poll", "document", "video") if k in m.kinds), None) or (("album" if len(m.photos) > 1 else "photo") if m.photos else None)
        urls = [u for u in m.photos if u] + ([m.video_src] if m.video_src else [])
        has_media = kind is not None or bool(urls)
        if not text and has_media:
            text = f"[{(kind or 'media').upper()}]"
        joined = lambda x: None if x is None else "".join(s.strip() for s in x)
        self.posts.append((channel, message_id, m.time, text, has_media, kind, urls, f"https://t.me/{channel}/{message_id}", joined(m.forward), joined(m.views)))

    def close(self):
        super().close()
        self._end_message()


def tidy(text: str) -> str:
    """Lines stripped, at most one blank line in a row, nothing around."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in text.splitlines()).strip())


def parse_page(html: str | None, default_channel: str | None = None) -> list[tuple]:
    """Posts (values of POST) of a page; service messages and malformed ones are left out."""
    p = _Parser(default_channel)
    p.feed(html or "")
    p.close()
    return p.posts


def posts(pages: DataFrame) -> DataFrame:
    """Posts of pages (channel, html): POST, with published_at as an instant (the epoch if unknown)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in POST.split(", ")]
        for f in frames:
            yield pd.DataFrame([p for c, h in zip(f["channel"], f["html"], strict=True) for p in parse_page(h, c)], columns=names)

    out = pages.select("channel", "html").mapInPandas(run, POST)
    return out.withColumn("published_at", iso_instant(F.col("published"))).drop("published")


def page_url(channel: Column, before: Column | None = None) -> Column:
    """Preview URL of a channel, before a message id if one is given."""
    url = F.concat(F.lit("https://t.me/s/"), F.regexp_replace(F.lower(channel), "^@+", ""))
    return url if before is None else F.when(before.isNotNull(), F.concat(url, F.lit("?before="), before.cast("string"))).otherwise(url)


def walk(fetcher: PageFetcher, channel: str, known: set[int], pages: int = 1, most_new: int = 200) -> list[tuple]:
    """New posts of a channel: its newest page, then older ones by the smallest id, until a page holds a known
    post, is empty or can't be had, or the page budget (1 to 50) or most_new is used up."""
    found, before = [], None
    for _ in range(min(50, max(1, pages))):
        html = fetcher.fetch(channel, before)
        page = parse_page(html, channel) if html else []
        if not page:
            break
        new = sorted((p for p in page if p[1] not in known), key=lambda p: -p[1])
        found += new[: most_new - len(found)]
        oldest = min(p[1] for p in page)
        if len(found) >= most_new or len(new) < len(page) or (before is not None and oldest >= before):
            break
        before = oldest
    return found


class ChannelPages(DataSource):
    """Spark source 'channel_pages': the newest page of each channel, one partition a channel.

    Options: channels (comma-separated) and fetcher ('module:factory', called on the executors)."""

    @classmethod
    def name(cls) -> str:
        return "channel_pages"

    def schema(self) -> str:
        return "channel string, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ChannelReader(self.options)


class _ChannelReader(DataSourceReader):
    def __init__(self, options):
        self.channels = [c.strip() for c in options["channels"].split(",") if c.strip()]
        self.fetcher = options["fetcher"]

    def partitions(self):
        return [InputPartition(c) for c in self.channels]

    def read(self, partition):
        import importlib

        module, _, factory = self.fetcher.partition(":")
        html = getattr(importlib.import_module(module), factory)().fetch(partition.value)
        if html is not None:
            yield partition.value, html
