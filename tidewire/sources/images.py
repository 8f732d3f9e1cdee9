"""Image relay: fetch a public image within bounds, upload it once and remember its key."""

from __future__ import annotations

from collections import OrderedDict
from typing import Protocol
from urllib.parse import urljoin, urlsplit

from .sinks import IMAGE_MAX_BYTES, IMAGE_MIN_BYTES, host_is_public


class ImageTransport(Protocol):
    """get: (status, headers, at most `most` + 1 bytes); put: the stored image's key, or None."""

    def get(self, url: str, most: int) -> tuple[int, dict[str, str], bytes]: ...

    def put(self, kind: str, data: bytes) -> str | None: ...


MAGIC = ((b"\xff\xd8\xff", "jpg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"BM", "bmp"), (b"\x00\x00\x01\x00", "ico"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"))


def kind_of(data: bytes) -> str | None:
    if len(data) < IMAGE_MIN_BYTES:
        return None
    if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
        return "webp"
    return next((k for m, k in MAGIC if data.startswith(m)), None)


class Relay:
    """Keys of relayed images by URL; the least recently used ones are forgotten beyond `remembered`."""

    def __init__(self, transport: ImageTransport, remembered: int = 1000, redirects: int = 3):
        self.transport, self.remembered, self.redirects = transport, remembered, redirects
        self.keys: OrderedDict[str, str] = OrderedDict()

    def key(self, url: str) -> str | None:
        if url in self.keys:
            self.keys.move_to_end(url)
            return self.keys[url]
        data = self._fetch(url)
        kind = kind_of(data) if data else None
        key = self.transport.put(kind, data) if kind else None
        if key:
            self.keys[url] = key
            if len(self.keys) > self.remembered:
                self.keys.popitem(last=False)
        return key

    def _fetch(self, url: str) -> bytes | None:
        for _ in range(self.redirects + 1):
            parts = urlsplit(url)
            if parts.scheme not in ("http", "https") or not host_is_public(parts.hostname):
                return None
            status, headers, data = self.transport.get(url, IMAGE_MAX_BYTES)
            if status in (301, 302, 303, 307, 308) and headers.get("location"):
                url = urljoin(url, headers["location"])
                continue
            return data if status == 200 and len(data) <= IMAGE_MAX_BYTES else None
        return None
