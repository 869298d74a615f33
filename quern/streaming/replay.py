"""Streams that end: logs in files replayed with their state, merged into a table, and resumed from where they stopped.

Each runs with the trigger availableNow, so a call takes in what has come since the last one: offsets and state are in the
folder's checkpoint. What a micro-batch yields is written under its number, so a batch that runs again after a failure
replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from quern.operators import submit
from quern.streaming.log import streaming_latest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _run(stream: DataFrame, mode: str, folder: str, batches: int | None = None) -> DataFrame:
    """Take in all there is (or so many batches) and return every row written so far, with the number of its batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if batches is not None and number >= batches:
            raise InterruptedError("stopped as asked")
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    except Exception as e:
        if batches is None or "stopped as asked" not in str(e):
            raise
    schema = stream.schema.add("batch", "long")
    rows = spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/rows") if run.lastProgress or batches is None else rows


def latest(events: DataFrame, keys: list[str], value: str, order: list[str], folder: str, batches: int | None = None) -> DataFrame:
    """T5, A3: the last value of each key. Only keys that changed are written (update mode); readers take each key's last batch."""
    rows = _run(streaming_latest(events, keys, value, order), "update", folder, batches)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def eligible(records: DataFrame, consensus: DataFrame, submissions: DataFrame, keys: list[str], value: str, folder: str, batches: int | None = None) -> DataFrame:
    """F10 over a stream of records, joined with what is agreed and sent as tables: every record with its reason."""
    return _run(submit.eligibility(records, consensus, submissions, keys, value), "append", folder, batches).drop("batch")


class _Poll(StatefulProcessor):
    """A transaction's first sight and whether it is done; a timer ends the wait."""

    def __init__(self, timeout: timedelta):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", StructType([StructField("first", TimestampType()), StructField("done", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, done = self.state.get() if self.state.exists() else (None, False)
        seen = pd.concat(list(rows)).sort_values(["ts", "status"])
        if done or not len(seen):
            return
        if first is None:
            first = seen["ts"].iloc[0].to_pydatetime()
            self.handle.registerTimer(int((pd.Timestamp(first) + self.timeout).timestamp() * 1000))
        end = seen[seen["status"].isin(("success", "failed"))]
        status = None
        if len(end):
            status = end["status"].iloc[0] if end["ts"].iloc[0] <= pd.Timestamp(first) + self.timeout else "timed_out"
        self.state.update((first, status is not None))
        if status:
            yield pd.DataFrame({"tx": [key[0]], "status": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, done = self.state.get()
        self.state.update((first, True))
        if not done:
            yield pd.DataFrame({"tx": [key[0]], "status": ["timed_out"]})

    def close(self) -> None:
        pass


def polled(observations: DataFrame, folder: str, timeout: timedelta = timedelta(minutes=15), late: str = "0 seconds", batches: int | None = None) -> DataFrame:
    """Tx, status of transactions that came to an end: by an observation within the timeout from the first one, or by the timeout.

    observations: tx string, ts timestamp, status string. Time is that of the observations: a wait ends when their watermark
    passes its deadline, so a replay gives what the live stream gave.
    """
    spark = observations.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the store that timers need; taken over when the stream starts
    try:
        seen = observations.select("tx", "ts", "status").withWatermark("ts", late)
        ended = seen.groupBy("tx").transformWithStateInPandas(_Poll(timeout), "tx string, status string", "append", "eventtime")
        return _run(ended, "append", folder, batches).drop("batch")
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
