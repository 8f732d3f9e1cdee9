"""Record sinks: delivery outcome, request signing, image checks."""

from __future__ import annotations

import base64
import hashlib
import hmac
import ipaddress
import json
from collections.abc import Callable
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_MAX_BYTES, IMAGE_MIN_BYTES = 10 << 20, 12
#: Leading bytes by kind (hex, with . for any digit).
IMAGES = (
    ("jpg", "^FFD8FF"), ("png", "^89504E470D0A1A0A"), ("gif", "^474946383[79]61"), ("webp", "^52494646.{8}57454250"), ("bmp", "^424D"), ("ico", "^00000100"), ("tiff", "^(49492A00|4D4D002A)"),
)


class Transport(Protocol):
    """Anything that posts a body: returns (HTTP status, or None for a network failure, and the reply)."""

    def post(self, url: str, body: str, headers: dict[str, str]) -> tuple[int | None, str]: ...


def signature(timestamp: str, secret: str) -> str:
    """Base64 of the HMAC-SHA256 of an empty message under 'timestamp\\nsecret'."""
    return base64.b64encode(hmac.new(f"{timestamp}\n{secret}".encode(), b"", hashlib.sha256).digest()).decode()


@F.pandas_udf(T.StringType())
def signatures(timestamp: pd.Series, secret: pd.Series) -> pd.Series:
    return pd.Series([signature(t, s) for t, s in zip(timestamp, secret, strict=True)])


def request(card: str, timestamp: str, secret: str | None) -> tuple[str, dict[str, str]]:
    """Body and headers of a delivery; signed if there is a secret."""
    body: dict = {"msg_type": "interactive", "card": json.loads(card)}
    headers = {"Content-Type": "application/json; charset=utf-8"}
    if secret:
        body |= {"timestamp": timestamp, "sign": signature(timestamp, secret)}
        headers |= {"X-Timestamp": timestamp, "X-Signature": body["sign"]}
    return json.dumps(body, ensure_ascii=False), headers


def outcome(status: Column, reply: Column) -> Column:
    """sent, retry or failed: by HTTP status, then by the code in the reply."""
    fields = F.from_json(reply, "code long, StatusCode long")  # a code given as text is none
    code = F.coalesce(fields["code"], fields["StatusCode"])
    return (
        F.when(status.isNull() | (status == 429) | status.between(500, 599), "retry")
        .when((status == 200) & (code == 0), "sent")
        .when((status == 200) & (code == 19001), "retry")
        .otherwise("failed")
    )


def outcome_of(status: int | None, reply: str) -> str:
    """outcome() of one reply, for a sink on the driver."""
    if status is None or status == 429 or 500 <= status <= 599:
        return "retry"
    try:
        fields = json.loads(reply)
        code = fields.get("code", fields.get("StatusCode"))
    except (ValueError, AttributeError):
        code = None
    return ("sent" if code == 0 else "retry" if code == 19001 else "failed") if status == 200 else "failed"


def deliver(transport: Transport, url: str, card: str, timestamp: str, secret: str | None = None, retries: int = 3, wait: Callable[[int], None] = lambda attempt: None) -> bool:
    """Post a card until it is sent, fails for good or the retries are used up."""
    body, headers = request(card, timestamp, secret)
    for attempt in range(max(1, retries)):
        result = outcome_of(*transport.post(url, body, headers))
        if result != "retry":
            return result == "sent"
        wait(attempt)
    return False


def image_kind(data: Column) -> Column:
    """Kind of an image by its leading bytes, null for others and for fewer than 12 bytes."""
    head = F.hex(F.substring(data, 1, IMAGE_MIN_BYTES))
    out = F.when(F.octet_length(data) < IMAGE_MIN_BYTES, F.lit(None).cast("string"))
    for kind, pattern in IMAGES:
        out = out.when(head.rlike(pattern), kind)
    return out


def host_is_public(host: str | None) -> bool:
    """Whether a host may be fetched from: a name with a dot that isn't local, or a global address."""
    host = (host or "").strip("[]").rstrip(".").lower()
    if not host:
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return "." in host and not host.endswith((".local", ".internal", ".localhost"))


@F.pandas_udf(T.BooleanType())
def safe_image_url(url: pd.Series) -> pd.Series:
    """Whether a URL is http(s) on a public host."""

    def ok(u) -> bool:
        try:
            p = urlsplit(u or "")
            return p.scheme in ("http", "https") and host_is_public(p.hostname)
        except ValueError:
            return False

    return url.map(ok)
