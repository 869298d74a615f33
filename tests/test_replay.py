"""Streams against their batch forms, also when they stop half-way and start again."""

from datetime import timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import submit
from quern.streaming import replay

SF = "/root/testdata/sf0.001"


def logs(spark, tmp_path, parts=4):
    """The events in files by time."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("part", F.ntile(parts).over(W.orderBy("ts", "event_id")))
    for k in range(1, parts + 1):
        events.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    return lambda: spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"), events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_and_restart(spark, tmp_path):
    stream, events = logs(spark, tmp_path)
    want = rows(submit.latest(events, ["user_id"], "event_type", ["ts", "event_id"]))
    args = (["user_id"], "event_type", ["ts", "event_id"], f"file://{tmp_path}/state")
    early = rows(replay.latest(stream(), *args, batches=2))
    assert early and early != want
    assert rows(replay.latest(stream(), *args)) == want
    assert rows(replay.latest(stream(), *args)) == want  # nothing new
    assert len(list((tmp_path / "state" / "rows").glob("batch=*"))) >= 4


def test_eligibility_of_a_stream(spark, tmp_path):
    stream, events = logs(spark, tmp_path)
    keys = ["user_id"]
    agreed, sent = submit.latest(events, keys, "event_type", ["ts", "event_id"]), events.filter("event_id % 5 = 0")
    take = lambda df: df.select("event_id", "user_id", "event_type")
    want = rows(submit.eligibility(take(events), agreed, sent, keys, "event_type").select("event_id", "reason").fillna("-"))
    folder = f"file://{tmp_path}/state"
    replay.eligible(take(stream()), agreed, sent, keys, "event_type", folder, batches=1)
    assert rows(replay.eligible(take(stream()), agreed, sent, keys, "event_type", folder).select("event_id", "reason").fillna("-")) == want


def test_polling_with_timers(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    seen = [("a", 0, "pending"), ("b", 1, "pending"), ("c", 2, "pending"), ("a", 30, "success"), ("d", 40, "failed"), ("b", 70, "success"), ("e", 100, "pending"), ("e", 120, "failed"), ("a", 130, "failed"), ("f", 200, "pending")]
    for k in range(0, len(seen), 2):
        spark.createDataFrame([(tx, at(s), status) for tx, s, status in seen[k : k + 2]], "tx string, ts string, status string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = lambda: spark.readStream.schema("tx string, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    folder = f"file://{tmp_path}/state"
    assert len(rows(replay.polled(stream(), folder, timedelta(seconds=60), batches=2))) <= 2
    got = rows(replay.polled(stream(), folder, timedelta(seconds=60)))
    # b came too late, c never; f's deadline hasn't passed; what a says once it is done doesn't count.
    assert got == [("a", "success"), ("b", "timed_out"), ("c", "timed_out"), ("d", "failed"), ("e", "failed")]
