"""Counters of running streams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "query string, batch long, input_rows long, rows_per_s double, duration_ms long, dropped_late long, received long, emitted long"
OBSERVATION = "ingest"


def observed(readings: DataFrame, houses: list[int]) -> DataFrame:
    """Count readings received and passed on, without another pass."""
    emitted = (F.col("property") == 1) & F.col("house_id").isin(houses)
    return readings.observe(OBSERVATION, F.count(F.lit(1)).alias("received"), F.count_if(emitted).alias("emitted"))


class ProgressTable(StreamingQueryListener):
    """Appends one row per finished micro-batch to a Parquet table; nothing is kept on the driver.

    Rows are named by query, run and batch, so an event that is delivered twice overwrites itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: set[str] = set()
        self.failed: dict[str, Exception] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = (p.observedMetrics or {}).get(OBSERVATION)
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        counts = (seen["received"], seen["emitted"]) if seen else (None, None)
        row = (p.name or str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond, p.batchDuration, late, *counts)
        target = f"{self.path}/run={p.runId}/progress={p.batchId}"
        try:
            # a batch can report more than once while no data arrives; its own report has the rows
            if p.numInputRows or p.batchId == 0:
                self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(target)
        except Exception as error:  # a listener must not stop the stream; the reader is told instead
            self.failed[str(p.id)] = error

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.id))

    def wait_for(self, query_id: str, seconds: float = 120.0) -> None:
        """Return when all of a stopped query's rows are written: events arrive in order, a little after the query has stopped."""
        deadline = time.monotonic() + seconds
        while query_id not in self.ended:
            if time.monotonic() > deadline:
                raise TimeoutError(f"the end of query {query_id} was not reported within {seconds} s")
            time.sleep(0.05)
        if query_id in self.failed:
            raise RuntimeError(f"progress of query {query_id} could not be written") from self.failed[query_id]


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).parquet(f"{path}/run=*/progress=*")
