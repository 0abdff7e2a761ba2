"""Live ledgers: a stream of events with state for each log.

Events of a log must come with times that count on by one.  An event out of
order waits in the log's state until the gap before it closes, so the state is
bounded by how far events overtake each other; a time that was taken already is
reported and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "log_id string, time bigint, kind string, status string, open_requests bigint"
_STATE = "next bigint, open bigint, times array<bigint>, kinds array<string>"


def follow(events: DataFrame) -> DataFrame:
    """Accept each log's events in order of time, as they become ready.

    ``events`` streams ``log_id`` (string), ``time`` (bigint) and ``kind``.
    Returns a row for each event once it can be placed: ``status`` is
    ``accepted`` or ``duplicate``; ``open_requests`` counts Requests less
    Responses so far.  Rows with a null key or time are left out.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, opened, waiting = 1, 0, {}
        if state.exists:
            following, opened, times, kinds = state.get
            waiting = dict(zip(times, kinds))
        out: list[tuple] = []
        for pdf in batches:
            for time, kind in zip(pdf["time"].tolist(), pdf["kind"].tolist()):
                if time < following or time in waiting:
                    out.append((key[0], time, kind, "duplicate", opened))
                else:
                    waiting[time] = kind
        while following in waiting:
            kind = waiting.pop(following)
            opened += (kind == "Request") - (kind == "Response" and opened > 0)
            out.append((key[0], following, kind, "accepted", opened))
            following += 1
        state.update((following, opened, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["log_id", "time", "kind", "status", "open_requests"])

    usable = events.where("log_id is not null and time is not null").select("log_id", "time", "kind")
    return usable.groupBy("log_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
