"""Event logs as streams: the latest value of each key, and transactions polled until they are final or time out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_latest(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """T5: A3 over a stream, for update or complete mode; the state holds one row per key."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def windowed_counts(events: DataFrame, ts: str, column: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts per window and value; what comes later than the watermark is dropped, so state is bounded."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), column).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), column, "n")


def poll_status(observations: DataFrame, timeout_ms: int = 15 * 60 * 1000) -> DataFrame:
    """Tx, status: final once an observation says success or failed, timed_out after timeout_ms without one.

    observations: tx string, status string (pending, success, failed).
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (tx,) = key
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"tx": [tx], "status": ["timed_out"]})
            return
        final = next((s for f in frames for s in f["status"] if s in ("success", "failed")), None)
        if final:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"tx": [tx], "status": [final]})
        elif not state.exists:
            state.update((1,))
            state.setTimeoutDuration(timeout_ms)

    return observations.groupBy("tx").applyInPandasWithState(step, "tx string, status string", "seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)
