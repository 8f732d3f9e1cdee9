"""Stateful operators over streams, keyed by group; the logic is that of operators.admission.

State lives in Spark's state store and its time is event time, so a restarted query goes on where its
checkpoint left off and decides the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed
from ..operators.admission import Live

CLAIM_OUT = "group_id string, id long, claimed_s double, accepted boolean"
CLAIM_STATE = "prints array<string>, times array<double>"


def claim_stream(rows: DataFrame, window: int = fixed.WINDOW_SECONDS) -> DataFrame:
    """Decide claims (group_id, id, claimed_s, fingerprints): accepted if none of the fingerprints was accepted within
    `window` seconds. Within a batch rows go by time, then id. Keeps only the window's fingerprints of a group."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = Live(window, *(state.get if state.exists else ()))
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["claimed_s", "id"], kind="stable")
        accepted = [live.claim(float(now), prints) for now, prints in zip(rows["claimed_s"], rows["fingerprints"], strict=True)]
        state.update((list(live.taken), list(live.taken.values())))
        yield pd.DataFrame({"group_id": key[0], "id": rows["id"], "claimed_s": rows["claimed_s"], "accepted": accepted})

    picked = rows.select("group_id", "id", F.col("claimed_s").cast("double"), "fingerprints")
    return picked.groupBy("group_id").applyInPandasWithState(step, CLAIM_OUT, CLAIM_STATE, "append", GroupStateTimeout.NoTimeout)


CALL_OUT = "group_id string, id long, at_s double, accepted boolean"
CALL_STATE = "last double, day long, calls long"


def reservation_stream(rows: DataFrame, interval: int, per_group: int = fixed.DAILY_CALLS) -> DataFrame:
    """Decide call requests (group_id, id, at_s): after the cooldown and within the group's budget of the UTC day."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, day, calls = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at_s", "id"], kind="stable")
        accepted = []
        for now in rows["at_s"]:
            if day != int(now // 86400):
                day, calls = int(now // 86400), 0
            ok = (last is None or now - last >= interval) and calls < per_group
            if ok:
                last, calls = float(now), calls + 1
            accepted.append(ok)
        state.update((last, day, calls))
        yield pd.DataFrame({"group_id": key[0], "id": rows["id"], "at_s": rows["at_s"], "accepted": accepted})

    picked = rows.select("group_id", "id", F.col("at_s").cast("double"))
    return picked.groupBy("group_id").applyInPandasWithState(step, CALL_OUT, CALL_STATE, "append", GroupStateTimeout.NoTimeout)
