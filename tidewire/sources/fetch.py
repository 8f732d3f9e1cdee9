"""Getting a channel's page over HTTP: which answers are pages, and how long to wait before asking again."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

#: An answer: status, headers and body; status None stands for a network failure.
Answer = tuple[int | None, Mapping[str, str], str]


def urlopen(url: str, timeout: float = 20.0) -> Answer:
    """An answer by the standard library's client."""
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0", "Accept-Language": "en"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.headers, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.headers, ""
    except OSError:
        return None, {}, ""


@dataclass(frozen=True)
class Wait:
    """Seconds before another attempt: factor ** failures * scale and jitter, at most `most`."""

    scale: float
    most: float
    jitter: tuple[float, float] = (0.0, 0.0)

    def seconds(self, factor: float, failures: int, asked: float | None = None) -> float:
        base = asked if asked is not None else min(self.most, factor ** min(failures, 16) * self.scale)
        return base + random.uniform(*self.jitter)


# --- fixed values: waits after a refusal for load, a server's error and a network failure ---
BUSY, BROKEN, UNREACHABLE = Wait(5.0, 120.0, (0.5, 2.0)), Wait(2.0, 60.0, (0.2, 1.0)), Wait(1.5, 30.0)


def asked_wait(header: str | None, most: float) -> float | None:
    """Seconds of a Retry-After header, from 0 to most; None where it is no number."""
    try:
        v = float(header)
    except (TypeError, ValueError):
        return None
    return None if v != v else min(max(v, 0.0), most)


@dataclass
class HttpPages:
    """A PageFetcher: the body of an answer 200, after up to `attempts` tries; None for every other end.

    Refusals for load (429), server errors and network failures are tried again; other statuses, 403 and 404 among them, aren't.
    `failures` counts those in a row over all channels, so waits grow while a server is in trouble."""

    get: Callable[[str], Answer] = urlopen
    sleep: Callable[[float], object] = time.sleep
    attempts: int = 3
    factor: float = 2.0
    most: float = 120.0
    failures: int = field(default=0, init=False)

    def url(self, channel: str, before: int | None = None) -> str:
        return f"https://t.me/s/{channel.lower().lstrip('@')}" + ("" if before is None else f"?before={before}")

    def fetch(self, channel: str, before: int | None = None) -> str | None:
        for attempt in range(1, self.attempts + 1):
            status, headers, body = self.get(self.url(channel, before))
            if status == 200:
                self.failures = 0
                return body
            wait = UNREACHABLE if status is None else BUSY if status == 429 else BROKEN if 500 <= status < 600 else None
            if wait is None:
                return None
            self.failures += 1
            if attempt < self.attempts:
                asked = asked_wait(headers.get("Retry-After"), self.most) if wait is BUSY else None
                self.sleep(min(self.most, wait.seconds(self.factor, self.failures, asked)))
        return None
