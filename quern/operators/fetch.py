"""What surrounds requests: block ranges, flows times identifiers, responses, content that must match its hash, run rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions.formats import content_ok
from quern.functions.urls import fill_template

CHUNK = 2000


def block_ranges(scans: DataFrame, first: str = "first", last: str = "last", size: int = CHUNK) -> DataFrame:
    """Each row's range of blocks in consecutive chunks, both ends included; ranges without a block give no row."""
    starts = F.when(F.col(first) <= F.col(last), F.sequence(F.col(first), F.col(last), F.lit(size).cast("long")))
    rows = scans.withColumn("from_block", F.explode(starts))
    return rows.withColumn("to_block", F.least(F.col("from_block") + size - 1, F.col(last)))


def flow_requests(ids: DataFrame, flow: list[dict[str, str]], column: str = "request_identifier") -> DataFrame:
    """Every request of a flow for every identifier; a flow is a short list, so its rows are literals, not a join."""
    steps = F.array(*(F.struct(F.lit(s["key"]).alias("key"), F.lit(s.get("method", "GET")).alias("method"), F.lit(s["url"]).alias("url")) for s in flow))
    out = ids.filter(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) != "").withColumn("_s", F.explode(steps))
    return out.select(column, "_s.key", "_s.method", fill_template(F.col("_s.url"), F.col(column).cast("string")).alias("url"))


def response_kind(content_type: Column) -> Column:
    """Html or json."""
    return F.when(F.contains(F.lower(content_type), F.lit("html")), "html").otherwise("json")


def combine_responses(responses: DataFrame, column: str = "request_identifier") -> DataFrame:
    """Per identifier one JSON object, key -> response text, keys in order."""
    per = responses.groupBy(column).agg(F.array_sort(F.collect_list(F.struct("key", "response"))).alias("all"))
    return per.select(column, F.to_json(F.map_from_entries("all")).alias("combined"))


def verified(content: DataFrame, cid: str = "cid", data: str = "data", rank: str = "gateway") -> DataFrame:
    """Of each identifier the content from the first gateway whose hash fits."""
    good = content.filter(content_ok(F.col(cid), F.col(data)))
    return good.groupBy(cid).agg(F.min_by(data, rank).alias(data))


def rates(samples: DataFrame, group: str, ts: str, done: str, frame: int = 60) -> DataFrame:
    """Per sample the progress a second (to the millisecond) since the oldest of the last `frame` samples.

    That is what both rules of the meter come to: the first sample that is five seconds old or older is the oldest one, and where
    none is that old the oldest stands in. A single sample has rate 0; samples of one moment count from the group's start.
    """
    recent = W.partitionBy(group).orderBy(ts, done).rowsBetween(1 - frame, 0)
    sample = F.struct(F.col(ts).alias("t"), F.col(done).alias("d"))
    out = samples.withColumn("_o", F.first(sample).over(recent)).withColumn("_n", F.count(F.lit(1)).over(recent))
    out = out.withColumn("_s", F.min(ts).over(W.partitionBy(group)))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    out = out.withColumn("seconds", (ms(ts) - ms("_o.t")) / 1000).withColumn("gained", F.col(done) - F.col("_o.d"))
    since = (ms(ts) - ms("_s")) / 1000
    rate = F.when(F.col("_n") < 2, 0.0).when(F.col("seconds") > 0, F.col("gained") / F.col("seconds")).when(since > 0, F.col(done) / since).otherwise(0.0)
    return out.withColumn("rate", rate).drop("_o", "_n", "_s")


def remaining_seconds(total: Column, done: Column, rate: Column) -> Column:
    """The time that is left at a rate; null where nothing is left or nothing moves."""
    return F.when((rate > 0) & (total > done), (total - done) / rate)
