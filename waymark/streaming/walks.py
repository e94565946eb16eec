"""Walks as they happen: the running operators over a stream of steps.

The original data are finished files; these are the same rules for live feeds, with watermarks so
that state is bounded by how late a step may come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNNING = "user_id long, ts timestamp, edge string, first_visit boolean, running_unique long, elapsed_s long"
STATE = "seen array<string>, running long, elapsed long"


def merge_gaps(steps: DataFrame, gap: str, late: str) -> DataFrame:
    """user_id, lo, hi and steps of each stretch without a break longer than ``gap``; steps more
    than ``late`` behind are dropped. steps: user_id, ts."""
    stretch = steps.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("steps"))
    return stretch.select("user_id", F.col("w.start").alias("lo"), F.col("w.end").alias("hi"), "steps")


def running(steps: DataFrame, late: str, idle_ms: int = 86_400_000) -> DataFrame:
    """Each step with first_visit, running_unique and elapsed_s of its walk so far. Steps of one
    batch are taken in order of time; a walk idle for ``idle_ms`` of event time is forgotten.
    steps: user_id, ts, edge, score (long), seconds (long)."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, total, elapsed = state.get if state.exists else ([], 0, 0)
        seen = set(seen)
        part = pd.concat(list(frames)).sort_values(["ts", "edge"], kind="stable")
        rows = []
        for r in part.itertuples():
            first = r.edge not in seen
            seen.add(r.edge)
            total, elapsed = total + (int(r.score) if first else 0), elapsed + int(r.seconds)
            rows.append((key[0], r.ts, r.edge, first, total, elapsed))
        state.update((sorted(seen), total, elapsed))
        state.setTimeoutTimestamp(max(int(part.ts.max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(rows, columns=["user_id", "ts", "edge", "first_visit", "running_unique", "elapsed_s"])

    return steps.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(advance, RUNNING, STATE, "append", GroupStateTimeout.EventTimeTimeout)
