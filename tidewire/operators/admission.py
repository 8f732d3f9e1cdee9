"""Greedy sequential decisions: each depends on the ones accepted before it.

They can't be written with lag or fixed buckets. Rows are partitioned by key and sorted, and a task walks
them in batches with a state of a few values for each key; no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from .cut import cut


def fold(rows: DataFrame, key: list[str], order: list[str], step: Callable[[dict, tuple], bool], columns: list[str]) -> DataFrame:
    """rows with `accepted`, decided in order by step(state, values of `columns`); state starts empty for each key."""
    schema = rows.schema.add("accepted", "boolean")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, {}
        for f in frames:
            keys = list(zip(*(f[k] for k in key), strict=True)) if key else [()] * len(f)
            out = []
            for k, values in zip(keys, zip(*(f[c] for c in columns), strict=True), strict=True):
                if k != at:
                    at, state = k, {}
                out.append(step(state, values))
            yield f.assign(accepted=out)

    placed = rows.repartition(*[F.col(k) for k in key]) if key else rows.repartition(1)
    return placed.sortWithinPartitions(*key, *order).mapInPandas(run, schema)


class Live:
    """Fingerprints accepted in the last `window` seconds of a group, in the order of their times: each is added and removed once."""

    def __init__(self, window: int, prints: Iterable[str] = (), times: Iterable[float] = ()):
        self.window, self.taken = window, dict(zip(prints, times, strict=True))

    def claim(self, now: float, prints: Iterable[str]) -> bool:
        """Take all of prints unless one is taken. Calls should come in order of time; late ones only delay removals."""
        while self.taken and now - self.taken[oldest := next(iter(self.taken))] > self.window:
            del self.taken[oldest]
        if any(p in self.taken and now - self.taken[p] <= self.window for p in prints):
            return False
        for p in prints:
            self.taken.pop(p, None)
            self.taken[p] = now
        return True


def claims(rows: DataFrame, window: int = fixed.WINDOW_SECONDS) -> DataFrame:
    """From (group_id, fingerprint, claimed_s, id): accepted unless a claim accepted at most `window` seconds
    ago has the fingerprint. A rejected claim doesn't extend the window."""

    def step(state: dict, v: tuple) -> bool:
        if "last" in state and v[0] - state["last"] <= window:
            return False
        state["last"] = v[0]
        return True

    return fold(rows, ["group_id", "fingerprint"], ["claimed_s", "id"], step, ["claimed_s"])


def paired_claims(rows: DataFrame, window: int = fixed.WINDOW_SECONDS) -> DataFrame:
    """As claims, for rows with an array `fingerprints` (text and event key): accepted if none is taken, and then takes all.

    Keeps the fingerprints of the last `window` seconds of one group."""

    def step(state: dict, v: tuple) -> bool:
        live = state.setdefault("live", Live(window))
        return live.claim(v[0], v[1])

    return fold(rows, ["group_id"], ["claimed_s", "id"], step, ["claimed_s", "fingerprints"])


def _reserve(state: dict, group, now: float, interval: int, per_group: int, total: int | None) -> bool:
    day = int(now // 86400)
    if state.get("day") != day:
        state["day"], state["calls"], state["all"] = day, {}, 0
    last, calls = state.setdefault("last", {}), state["calls"]
    if group in last and now - last[group] < interval:
        return False
    if calls.get(group, 0) >= per_group or (total is not None and state["all"] >= total):
        return False
    last[group], calls[group], state["all"] = now, calls.get(group, 0) + 1, state["all"] + 1
    return True


def reservations(calls: DataFrame, interval: int, per_group: int = fixed.DAILY_CALLS) -> DataFrame:
    """From (group_id, at_s, id): accepted after the cooldown and within the group's budget of the UTC day."""
    return fold(calls, ["group_id"], ["at_s", "id"], lambda state, v: _reserve(state, v[0], v[1], interval, per_group, None), ["group_id", "at_s"])


DAY = 86400


def reservations_with_total(calls: DataFrame, interval: int, per_group: int = fixed.DAILY_CALLS, total: int = fixed.DAILY_CALLS) -> DataFrame:
    """As reservations, with a budget over all groups of the UTC day.

    The budget couples the groups, but only within a day; from one day to the next only each group's last call counts. So
    days are folded side by side, each with the last calls of the days before it as far as they are known. Where a fold
    changes what the next days start from, those days are folded again, until nothing changes: then every day started
    from what the days before it ended with, which is what one sequence over all days gives. Mostly only calls around
    midnight differ, so two or three rounds do; a chain of changes takes a round for each of its days at worst."""
    rows = calls.withColumn("_day", F.floor(F.col("at_s") / DAY).cast("long"))

    def folded(part: DataFrame, since: DataFrame) -> DataFrame:
        def step(state: dict, v: tuple) -> bool:
            group, now, before = v
            if group not in state.setdefault("last", {}) and before == before and before is not None:
                state["last"][group] = before
            return _reserve(state, group, now, interval, per_group, total)

        known = part.join(since, ["_day", "group_id"], "left")
        return fold(known, ["_day"], ["at_s", "id"], step, ["group_id", "at_s", "_since"])

    def starts(decided: DataFrame) -> DataFrame:
        """For each day and group the last accepted call before the day, if it is near enough to matter."""
        ends = decided.groupBy("_day", "group_id").agg(F.max(F.when(F.col("accepted"), F.col("at_s"))).alias("end"))
        before = Window.partitionBy("group_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        return ends.select("_day", "group_id", F.max("end").over(before).cast("double").alias("_since")).where(F.col("_day") * DAY - F.col("_since") < interval)

    since = rows.sparkSession.createDataFrame([], rows.select("_day", "group_id").schema.add("_since", "double"))
    decided = cut(folded(rows, since))
    while True:
        now = cut(starts(decided))
        one = lambda df, name: df.withColumnRenamed("_since", name)
        both = one(now, "_new").join(one(since, "_old"), ["_day", "group_id"], "full")
        stale = both.where(~F.col("_new").eqNullSafe(F.col("_old"))).select("_day").distinct()
        if stale.isEmpty():
            return decided.select(*calls.columns, "accepted")
        again = folded(rows.join(stale, "_day", "left_semi"), now)
        decided, since = cut(decided.join(stale, "_day", "left_anti").unionByName(again)), now


def night_alerts(alerts: DataFrame, interval: int = fixed.NIGHT_ALERT_INTERVAL) -> DataFrame:
    """From (group_id, at_s, id, escalation): accepted after the interval, or at once for an escalation."""

    def step(state: dict, v: tuple) -> bool:
        if "last" in state and v[0] - state["last"] < interval and not v[1]:
            return False
        state["last"] = v[0]
        return True

    return fold(alerts, ["group_id"], ["at_s", "id"], step, ["at_s", "escalation"])


def once_per_day(claims: DataFrame) -> DataFrame:
    """The first claim of each (group_id, day)."""
    return claims.groupBy("group_id", "day").agg(F.min(F.struct("at_s", "id")).alias("x")).select("group_id", "day", "x.at_s", "x.id")
