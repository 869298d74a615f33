"""Connected components of an undirected graph that no single machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Work


def components(links: DataFrame, work: Work, name: str) -> DataFrame:
    """links (x, y) -> (node, component), component the smallest node reachable; nodes without a link are left out.

    Each round takes the smallest label of all neighbours and then that label's own label, so labels travel ever
    farther; every round is written to the shared folder.
    """
    edges = work.save(f"{name}_edges", links.select("x", "y").union(links.select("y", "x")).filter("x != y").distinct())
    labels = work.save(f"{name}_0", edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    k = 0
    while True:
        k += 1
        seen = edges.join(labels, edges["y"] == labels["node"]).groupBy(F.col("x").alias("n_node")).agg(F.min("label").alias("n_label"))
        own = labels.join(seen, F.col("node") == F.col("n_node")).select("node", "label", F.least("label", "n_label").alias("best"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        step = own.join(jump, F.col("best") == F.col("j_node"), "left").select("node", F.least("best", F.coalesce("j_label", "best")).alias("label"), "label")
        step = step.toDF("node", "label", "old")
        new = work.save(f"{name}_{k}", step)
        done = new.filter("label != old").limit(1).count() == 0
        work.drop(f"{name}_{k - 1}")
        labels = new.select("node", "label")
        if done:
            work.drop(f"{name}_edges")
            return labels.withColumnRenamed("label", "component")
