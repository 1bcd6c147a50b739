"""The rolling tracker as a stream: windows of a number of events by user, which reset when they are full."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events of a window, as in the batch form.
SIZE = 10
OUT = "user_id long, window_no long, queries long, mean_latency double, failures long, full boolean"
STATE = "number long, events long, total double, valued long, failures long"


def _row(user: int, number: int, events: int, total: float, valued: int, failures: int, full: bool) -> dict:
    return {"user_id": user, "window_no": number, "queries": events, "mean_latency": round(total / valued, 6) if valued else None, "failures": failures, "full": full}


def stepper(size: int, idle_ms: int | None, forget_ms: int) -> Callable:
    """One user's step: the state is the open window's number, events, sum of latencies, and failures."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, events, total, valued, failures = state.get if state.exists else (0, 0, 0.0, 0, 0)
        out = []
        if state.hasTimedOut:
            if not events:  # nothing has come for long, and nothing is open: the user is forgotten
                state.remove()
                return
            out.append(_row(key[0], number, events, total, valued, failures, False))
            number, events, total, valued, failures = number + 1, 0, 0.0, 0, 0
        else:
            given = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")  # a user's events of one batch
            for value, kind in zip(given["value"].tolist(), given["event_type"].tolist(), strict=True):
                events += 1
                if value is not None and value == value:
                    total, valued = total + value, valued + 1
                failures += kind == "error"
                if events == size:
                    out.append(_row(key[0], number, events, total, valued, failures, True))
                    number, events, total, valued, failures = number + 1, 0, 0.0, 0, 0
        state.update((number, events, float(total), valued, int(failures)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms if events else forget_ms)
        if out:
            yield pd.DataFrame(out)

    return step


def count_windows(events: DataFrame, size: int = SIZE, idle_ms: int | None = None, forget_ms: int = 86_400_000) -> DataFrame:
    """(user_id, window_no, queries, mean_latency, failures, full) of a stream (user_id, ts, event_id, value, event_type).

    A full window is given out and the next one begins. With idle_ms, a window whose user sends nothing for so long
    is given out as it is; a user without an open window is forgotten after forget_ms, and numbers begin at 0 again.
    Within a batch events count by time and id, between batches by arrival; a trigger's size bounds what a user's
    group holds. Events without a user are left out. Full windows equal the batch form where the stream is in order.
    """
    rows = events.where(F.col("user_id").isNotNull()).select(F.col("user_id").cast("bigint").alias("user_id"), "ts", "event_id", F.col("value").cast("double").alias("value"), "event_type")
    wait = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("user_id").applyInPandasWithState(stepper(size, idle_ms, forget_ms), OUT, STATE, "append", wait)
