"""Time-of-day windows, freshness and modes. The clock is always an argument."""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed


def minutes(token: str) -> int:
    """Minutes from midnight of 'HH' or 'HH:MM'; ValueError for anything else."""
    parts = token.strip().split(":")
    if len(parts) > 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"not a time of day: {token!r}")
    hour, minute = int(parts[0]), int(parts[1]) if len(parts) == 2 else 0
    if hour > 23 or minute > 59:
        raise ValueError(f"not a time of day: {token!r}")
    return 60 * hour + minute


def zone(name: str) -> str:
    """The zone's name, checked; empty means Asia/Shanghai. ValueError for an unknown one."""
    name = (name or "").strip() or "Asia/Shanghai"
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise ValueError(f"unknown time zone: {name!r}") from e
    return name


@dataclass(frozen=True)
class Span:
    """A half-open daily window in minutes; it may wrap around midnight."""

    start: int
    end: int

    @classmethod
    def parse(cls, spec: str | None) -> Span | None:
        """From 'HH:MM-HH:MM'; None where the window is empty or of zero width."""
        spec = (spec or "").strip()
        if not spec:
            return None
        ends = spec.split("-")
        if len(ends) != 2:
            raise ValueError(f"not a window: {spec!r}")
        start, end = map(minutes, ends)
        return None if start == end else cls(start, end)

    def holds(self, minute: Column) -> Column:
        after, before = minute >= self.start, minute < self.end
        return after & before if self.start < self.end else after | before

    def window_id(self, local: Column) -> Column:
        """Local date on which the window that is active, or was last, began."""
        day = F.to_date(local)
        return day if self.start < self.end else F.when(minute_of_day(local) >= self.start, day).otherwise(F.date_sub(day, 1))


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def local_time(instant: Column, tz: str) -> Column:
    """Wall-clock time of an instant in a zone, as a timestamp without zone, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone(tz)), utc(instant))


def utc(instant: Column) -> Column:
    """An instant's UTC wall clock as a timestamp without zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_micros(instant) / F.lit(1_000_000).cast("decimal(20,0)"))


def mode(local: Column, quiet: str = "00:00-08:00", shoulder: str = "22:00-00:00") -> Column:
    """quiet, shoulder or day; quiet wins."""
    out, minute = F.lit(fixed.DAY), minute_of_day(local)
    for span, name in ((Span.parse(shoulder), fixed.SHOULDER), (Span.parse(quiet), fixed.QUIET)):
        if span:
            out = F.when(span.holds(minute), name).otherwise(out)
    return out


def day_start(quiet: str, shoulder: str) -> int:
    """Minute at which day mode begins."""
    span = Span.parse(quiet) or Span.parse(shoulder)
    return span.end if span else 0


def quiet_bounds(local: Column, quiet: str = "00:00-08:00") -> tuple[Column, Column]:
    """Local start and end of the current or latest quiet window."""
    span = Span.parse(quiet) or Span(0, 0)
    minute, day = minute_of_day(local), F.to_date(local).cast("timestamp_ntz")
    later = F.when(span.holds(minute) & (minute >= span.start), 1).otherwise(0) if span.start > span.end else F.lit(0)
    end = day + F.make_dt_interval(days=later, mins=F.lit(span.end))
    start = day + F.make_dt_interval(days=later - (1 if span.start >= span.end else 0), mins=F.lit(span.start))
    return start, end


def age_seconds(value: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(value)) / 1e6


def fresh(value: Column, max_age: Column | int | None, now: Column) -> Column:
    """Whether an instant is at most max_age seconds old and no more than the slack ahead.

    max_age of 0 or less: any age. A null instant or max_age: not fresh."""
    limit = F.lit(max_age).cast("long") if not isinstance(max_age, Column) else max_age.cast("long")
    age = age_seconds(value, now)
    return F.coalesce((age >= -fixed.FUTURE_SLACK) & ((limit <= 0) | (age <= limit)), F.lit(False))


def before(value: Column, now: Column) -> Column:
    """Whether an instant is no more than the slack ahead of now; a null one isn't."""
    return F.coalesce(age_seconds(value, now) >= -fixed.FUTURE_SLACK, F.lit(False))


def in_window(value: Column, start: Column, end: Column, now: Column) -> Column:
    """Whether an instant is in [start, end) and no more than the slack ahead of now."""
    return F.coalesce((value >= start) & (value < end), F.lit(False)) & before(value, now)


def iso_instant(text: Column) -> Column:
    """Instant of an ISO-8601 text; the epoch for texts without a zone or that don't parse."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(F.when(zoned, F.try_to_timestamp(text)), F.timestamp_seconds(F.lit(0)))


def knobs(spark: SparkSession) -> DataFrame:
    """Thresholds by mode, four rows."""
    rows = [(m, *v) for m, v in fixed.KNOBS.items()]
    return spark.createDataFrame(rows, "mode string, min_candidates int, max_wait int, min_interval int, min_score int, card_gap int, max_age int, card_cap int")


def morning_due(local: Column, quiet: str, enabled: bool = True) -> Column:
    """Whether it is within the hour after the quiet window's end."""
    if not enabled or not Span.parse(quiet):
        return F.lit(False)
    end = quiet_bounds(local, quiet)[1]
    return (local >= end) & (local < end + F.make_dt_interval(hours=F.lit(1)))
