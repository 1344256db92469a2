"""Gauges and counters of running queries, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "name string, batch_id long, input_rows long, seconds double, state_rows long"


class Progress(StreamingQueryListener):
    """Keeps the last `most` progress reports of a session's queries; add it with spark.streams.addListener."""

    def __init__(self, most: int = 10_000):
        self.most, self.rows = most, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self.rows = [*self.rows, (p.name or str(p.id), p.batchId, p.numInputRows, (p.durationMs or {}).get("triggerExecution", 0) / 1000, state)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)
