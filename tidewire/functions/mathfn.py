"""Retry and health arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPONENT_MAX = 16


def capped_backoff(factor: Column, attempt: Column, scale: Column, cap: Column) -> Column:
    """min(cap, factor ** min(attempt, 16) * scale); the cap where that is not a number."""
    raw = F.pow(factor, F.least(attempt, F.lit(EXPONENT_MAX))) * scale
    return F.when(F.isnan(raw) | raw.isNull(), cap).otherwise(F.least(cap, raw))


def jittered_backoff(attempt: Column, base: float = 2.0, most: float = 60.0, low: float = 0.1, high: float = 0.5, seed: int = 0) -> Column:
    """min(most, base * 2 ** attempt + jitter) with seeded jitter; attempts below 0 or null count as 0."""
    exponent = F.least(F.greatest(F.coalesce(attempt, F.lit(0)), F.lit(0)), F.lit(EXPONENT_MAX))
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), exponent) + F.rand(seed) * (high - low) + low)


def poll_delay(base: Column, ratio: float = 0.2, seed: int = 0) -> Column:
    """Seconds to the next poll: base, up to `ratio` of it more or less by a seeded draw; at least one second."""
    return F.greatest(F.lit(1.0), base * (1 + (2 * F.rand(seed) - 1) * ratio))


def channel_delay(low: float = 1.5, high: float = 3.5, seed: int = 0) -> Column:
    """Seconds between two channels, by a seeded draw."""
    return low + F.rand(seed) * (high - low)


def retry_after(header: Column, most: float) -> Column:
    """Seconds of a Retry-After header between 0 and most; null where it isn't a number."""
    v = F.trim(header).try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(0.0)), F.lit(most)))


def health_max_age(poll: Column, jitter: Column, override: Column | None = None) -> Column:
    """max(180, 3 * poll + jitter + 60) unless overridden."""
    own = F.greatest(F.lit(180), poll * 3 + jitter + 60)
    return own if override is None else F.coalesce(override, own)
