"""Progress without a second job: counts observed in the pass that does the work, samples of streams from a listener."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: How items end.
STATES = ("processed", "error", "skipped")


def counted(rows: DataFrame, state: str = "state") -> tuple[DataFrame, Observation]:
    """The rows as they are, and the counts of their states and of all, to be read once an action has passed over them."""
    seen = Observation()
    return rows.observe(seen, *(F.count_if(F.col(state) == s).alias(s) for s in STATES), F.count(F.lit(1)).alias("total")), seen


class Samples(StreamingQueryListener):
    """(phase, time, rows so far) after each micro-batch of a query that has a name; fetch.rates makes rates of them."""

    def __init__(self):
        self.rows: list[tuple[str, datetime, int]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name:
            before = next((n for name, _, n in reversed(self.rows) if name == p.name), 0)
            self.rows.append((p.name, datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")), before + p.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each micro-batch."""
        return spark.createDataFrame(self.rows, "phase string, ts timestamp, done long")
