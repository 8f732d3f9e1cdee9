"""Stateful processors with timers: digest gates, night alerts and the night archive with its recap.

All run on event time: rows of a key are taken in order of their times within a batch, and a timer is set where something is to
happen without a further row. So results don't depend on how the input is cut into batches, and a restarted query goes on
from its checkpoint. State sits in RocksDB (see use_rocksdb), so a group's state isn't bounded by a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed
from ..functions.timewin import Span

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries started from here on keep their state in RocksDB, as timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


#: Seconds since 1970, whatever the session's zone.
AT_S = "unix_micros(at) / 1e6 AS at_s"


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A batch's rows of one key: what a micro-batch brings of one group, bounded by the source's rate limit."""
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable")


GATE_OUT = "group_id string, n long, oldest_s double, opened_s double, reason string"


class Gate(StatefulProcessor):
    """Buffers a group's candidates until `least` are there, an urgent one comes, or the oldest has waited `max_wait` seconds.

    At night (a row's `quiet`) the number doesn't open the buffer; only urgent rows and the wait of `quiet_wait` do."""

    def __init__(self, least: int, max_wait: int, quiet_wait: int | None = None):
        self.least, self.max_wait, self.quiet_wait = least, max_wait, max_wait if quiet_wait is None else quiet_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getValueState("buffer", "n long, oldest double, due double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, oldest, due = self.buffer.get() if self.buffer.exists() else (0, None, None)
        was, out = due, []
        for now, urgent, quiet in _in_order(rows, ["at_s"])[["at_s", "urgent", "quiet"]].itertuples(index=False):
            if n and now >= due:  # the buffer opened before this row came
                out.append((n, oldest, due, "waited"))
                n, oldest = 0, None
            if not n:
                oldest, due = now, math.inf
            n += 1
            # the wait is that of the mode of the latest row
            due = oldest + (self.quiet_wait if quiet else self.max_wait)
            if urgent or (n >= self.least and not quiet) or now >= due:
                out.append((n, oldest, now, "urgent" if urgent else "count" if n >= self.least and not quiet else "waited"))
                n, oldest, due = 0, None, None
        if was is not None and was != due:
            self.handle.deleteTimer(_ms(was))
        if n:
            self.buffer.update((n, oldest, due))
            self.handle.registerTimer(_ms(due))
        else:
            self.buffer.clear()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.buffer.exists():
            n, oldest, due = self.buffer.get()
            if _ms(due) <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((n, oldest, due, "waited"))
                self.buffer.clear()
        yield self._rows(key, out)

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["n", "oldest_s", "opened_s", "reason"])
        frame.insert(0, "group_id", key[0])
        return frame.astype({"group_id": object, "n": "int64", "oldest_s": float, "opened_s": float, "reason": object})

    def close(self) -> None:
        pass


def _ms(seconds: float) -> int:
    """A timer's time: the first millisecond at which it is due."""
    return math.ceil(seconds * 1000)


def gate_stream(rows: DataFrame, least: int, max_wait: int, quiet_wait: int | None = None) -> DataFrame:
    """Candidates (group_id, at timestamp with a watermark, urgent, quiet): a row for each time a group's buffer opens."""
    picked = rows.selectExpr("group_id", "at", AT_S, "urgent", "quiet")
    return picked.groupBy("group_id").transformWithStateInPandas(Gate(least, max_wait, quiet_wait), GATE_OUT, "append", "eventTime")


ALERT_OUT = "group_id string, id long, at_s double, accepted boolean"


class NightAlerts(StatefulProcessor):
    """An alert goes out `interval` seconds after the group's last one, or at once if it is an escalation. The state goes
    when the interval is over: an alert after that is accepted anyway."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = was = self.last.get()[0] if self.last.exists() else None
        frame, accepted = _in_order(rows, ["at_s", "id"]), []
        for now, escalation in zip(frame["at_s"], frame["escalation"], strict=True):
            ok = last is None or now - last >= self.interval or bool(escalation)
            last = now if ok else last
            accepted.append(ok)
        if last != was:
            if was is not None:
                self.handle.deleteTimer(_ms(was + self.interval))
            self.last.update((last,))
            self.handle.registerTimer(_ms(last + self.interval))
        yield pd.DataFrame({"group_id": key[0], "id": frame["id"].to_numpy(), "at_s": frame["at_s"].to_numpy(), "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and _ms(self.last.get()[0] + self.interval) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame({"group_id": pd.Series(dtype=object), "id": pd.Series(dtype="int64"), "at_s": pd.Series(dtype=float), "accepted": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def night_alert_stream(rows: DataFrame, interval: int = fixed.NIGHT_ALERT_INTERVAL) -> DataFrame:
    """Alerts (group_id, id, at timestamp with a watermark, escalation): each with whether it goes out."""
    picked = rows.selectExpr("group_id", "id", "at", AT_S, "escalation")
    return picked.groupBy("group_id").transformWithStateInPandas(NightAlerts(interval), ALERT_OUT, "append", "eventTime")


class Night:
    """The quiet window of a local zone as nights: each has the date of its end."""

    def __init__(self, quiet: str = "00:00-08:00", tz: str = "Asia/Shanghai"):
        span = Span.parse(quiet)
        if span is None:
            raise ValueError(f"no quiet window: {quiet!r}")
        self.span, self.zone = span, ZoneInfo(tz)

    def of(self, at_s: float) -> tuple[str, float] | None:
        """Date and end (seconds since 1970) of the night that an instant lies in; None by day."""
        local = datetime.fromtimestamp(at_s, self.zone)
        minute = local.hour * 60 + local.minute
        if not self.span.holds(minute):
            return None
        day = local.date() + timedelta(days=1 if self.span.start > self.span.end and minute >= self.span.start else 0)
        end = datetime(day.year, day.month, day.day, self.span.end // 60, self.span.end % 60, tzinfo=self.zone)
        return day.isoformat(), end.timestamp()


RECAP_OUT = "group_id string, day string, rank int, channel string, message_id long, score int"


class NightArchive(StatefulProcessor):
    """Keeps a group's night items by day, channel and post; a later item of a post replaces the earlier one. At the end of
    a night its recap comes out: the best `most` items by score, then time, one for each fingerprint. Days more than `days`
    before are dropped then, with the map's entries."""

    def __init__(self, night: Night, most: int, days: int = 3):
        self.night, self.most, self.days = night, most, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "day string, channel string, message_id long", "at double, score int, fingerprint string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for r in _in_order(rows, ["at_s", "score", "fingerprint"]).itertuples(index=False):
            found = self.night.of(r.at_s)
            if found:
                self.items.updateValue((found[0], r.channel, int(r.message_id)), (float(r.at_s), int(r.score), r.fingerprint))
                self.handle.registerTimer(_ms(found[1]))
        yield self._rows(key, "", [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the timer stands at a night's end, whose date is the night's
        day = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, self.night.zone).date()
        oldest, tonight = (day - timedelta(days=self.days)).isoformat(), []
        gone = []
        for (d, channel, message_id), (at, score, fingerprint) in self.items.iterator():
            if d == day.isoformat():
                tonight.append((-score, -at, channel, message_id, fingerprint))
            elif d < oldest:
                gone.append((d, channel, message_id))
        for k in gone:
            self.items.removeKey(k)
        best: dict[str, tuple] = {}
        for item in sorted(tonight):
            best.setdefault(item[4], item)
        yield self._rows(key, day.isoformat(), [(n + 1, i[2], i[3], -i[0]) for n, i in enumerate(list(best.values())[: self.most])])

    def _rows(self, key, day: str, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["rank", "channel", "message_id", "score"])
        frame.insert(0, "group_id", key[0])
        frame.insert(1, "day", day)
        return frame.astype({"group_id": object, "day": object, "rank": "int32", "channel": object, "message_id": "int64", "score": "int32"})

    def close(self) -> None:
        pass


def night_recap_stream(rows: DataFrame, night: Night, most: int = fixed.BATCH, days: int = 3) -> DataFrame:
    """Items (group_id, channel, message_id, at timestamp with a watermark, score, fingerprint): each night's recap at its end."""
    picked = rows.selectExpr("group_id", "channel", "message_id", "at", AT_S, "score", "fingerprint")
    return picked.groupBy("group_id").transformWithStateInPandas(NightArchive(night, most, days), RECAP_OUT, "append", "eventTime")
