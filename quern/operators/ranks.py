"""Exact places of rows in an order, over all of a table or within groups, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The rows with `name`, their place from 0 in ascending order (nulls first), counted within each group of `by`.

    Rows are dealt to ranges and numbered there, once: the checkpoint keeps the numbers, so that the offsets, which are
    counts by range, belong to the very rows that they are added to. Equal keys are told apart by a hash of all columns,
    which also splits a key that holds many rows; a group that spans many ranges is no single task's either.
    """
    by = by or []
    tie = F.xxhash64(*rows.columns)
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)] + [tie]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = dealt.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at")).checkpoint()
    counts = dealt.groupBy(*by, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A row for each range, and one more for each group at most.
    shifts = counts.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__range").alias("__of"), (before - F.col("__first")).alias("__shift"))
    same = F.col("__range") == F.col("__of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return dealt.join(shifts, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(name))
