"""Keyed state in streams: rows of a key are held until they are all there, then given up with their state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_groups(df: DataFrame, key: str, time: str, n: int, late: str, wait_ms: int) -> DataFrame:
    """``key, rows, complete``: the rows of a key (JSON, in order of ``time``) once ``n`` of them have come.

    State of a key is dropped as soon as it is complete, and, with what has come so far and ``complete`` false, when the
    watermark (``late`` behind the latest time) is ``wait_ms`` past its last row: keys that never complete don't stay.
    A key that comes again begins anew. Rows without key or time are left out. ``df`` must be a stream.
    """
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    rows = (
        df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
        .select(F.col(key).cast("string").alias("key"), F.col(time).alias("time"), payload.alias("row")).withWatermark("time", late)
    )

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [name[0]], "rows": [[r for _, r in held]], "complete": [False]})
            return
        latest = 0
        for frame in frames:
            held += [[int(t.timestamp() * 1000), r] for t, r in zip(frame["time"], frame["row"])]
        held.sort()
        out = []
        while len(held) >= n:
            out.append([r for _, r in held[:n]])
            held = held[n:]
        if held:
            latest = max(t for t, _ in held)
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(latest + wait_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [name[0]] * len(out), "rows": out, "complete": [True] * len(out)})

    return rows.groupBy("key").applyInPandasWithState(run, "key string, rows array<string>, complete boolean", "held string", "append", "EventTimeTimeout")
