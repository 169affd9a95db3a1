"""Activities from a stream of events (user_id, ts, application), and counts by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTIVITY = "user_id long, application string, start_time timestamp, end_time timestamp, n_events long"


def activities(events: DataFrame, late: str = "120 seconds", idle: str = "1 hour") -> DataFrame:
    """Finished activities: one ends where another application of the user begins, or after `idle` without events. Events more
    than `late` behind are dropped; within a batch they are taken by time."""
    gap = pd.Timedelta(idle)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, now = [], state.getOption
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *now)], columns=["user_id", "application", "start_time", "end_time", "n_events"])
            return
        rows = pd.concat(frames).sort_values("ts", kind="stable")
        for app, ts in zip(rows.application, rows.ts, strict=True):
            if now is not None and (now[0] != app or ts - now[2] > gap):
                done.append((key[0], *now))
                now = None
            now = (app, ts, ts, 1) if now is None else (app, now[1], max(now[2], ts), now[3] + 1)
        state.update(now)
        state.setTimeoutTimestamp(max(int((now[2] + gap).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["user_id", "application", "start_time", "end_time", "n_events"])

    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(step, ACTIVITY, "application string, start_time timestamp, end_time timestamp, n_events long", "append", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, size: str = "15 seconds", late: str = "120 seconds") -> DataFrame:
    """Events and mean value by kind and tumbling window; windows are final once the watermark has passed them."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n", "mean")
