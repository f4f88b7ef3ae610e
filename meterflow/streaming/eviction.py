"""Slices that leave memory some time after their last update.

A device's slice is live while readings keep coming. Every flush adds its readings to the live slices; one that nothing has reached
for ``idle_ms`` of processing time is emitted as final and is not carried on. A reading that comes later opens the slice again, from
zero; openings are named by the flush that began them, so nothing is kept of a dropped slice, and the sum over all openings is the slice's total.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterflow.functions.slices import exact_sum, slice_index, utc_date
from meterflow.schemas import DEVICE, SLICE
from meterflow.session import delete
from meterflow.streaming.partials import FLUSH_INTERVAL, read_or_empty

#: Fixed value: a slice is dropped three hours after its last update.
IDLE_MS = 3 * 3_600_000
KEYS = [*DEVICE, *SLICE]
_TOTALS = (
    "house_id int, household_id int, plug_id int, read_date date, slice_gap int, slice_index int, "
    "opening long, value_count long, value_sum double, event_ts long, due_ms long"
)
_LIVE = f"{_TOTALS}, changed boolean"
_OUT = f"{_TOTALS}, final boolean"
COLUMNS = [c.split()[0] for c in _TOTALS.split(", ")]


def live_slices(held: DataFrame, readings: DataFrame, flush: int, gap: int, idle_ms: int, now_ms: int) -> DataFrame:
    """The slices that are live after a flush: those held that are not due, with the flush's readings, and those that its readings open.

    One aggregation with partial sums in front of its shuffle; a slice's opening is the first flush among its rows.
    """
    carried = held.where(F.col("due_ms") > now_ms).withColumn("changed", F.lit(False))
    single = readings.dropna(subset=DEVICE).select(
        *DEVICE,
        *_slice_of(gap),
        F.lit(flush).cast("long").alias("opening"),
        F.lit(1).cast("long").alias("value_count"),
        F.col("value").alias("value_sum"),
        F.col("event_ms").alias("event_ts"),
        F.lit(now_ms + idle_ms).cast("long").alias("due_ms"),
        F.lit(True).alias("changed"),
    )
    added = carried.unionByName(single).groupBy(*KEYS)
    return added.agg(
        F.min("opening").alias("opening"),
        F.sum("value_count").alias("value_count"),
        F.sum("value_sum").alias("value_sum"),
        F.max("event_ts").alias("event_ts"),
        F.coalesce(F.max(F.when(F.col("changed"), F.col("due_ms"))), F.max("due_ms")).alias("due_ms"),
        F.bool_or("changed").alias("changed"),
    )


def _slice_of(gap: int) -> tuple[Column, ...]:
    return utc_date("event_ms").alias("read_date"), F.lit(gap).alias("slice_gap"), slice_index("event_ms", gap).alias("slice_index")


def flush_slices(readings: DataFrame, root: str, flush: int, gap: int = 30, idle_ms: int = IDLE_MS, now_ms: int | None = None) -> None:
    """One flush: rows of changed slices (``final`` false, totals of this opening so far), and one ``final`` row for a slice that is dropped.

    The live slices are written under the flush's number and the ones of the flush before stay until the next, so a flush that runs again
    starts from the same slices and overwrites its own folders.
    """
    spark, now = readings.sparkSession, int(time.time() * 1000) if now_ms is None else now_ms
    held = read_or_empty(spark, f"{root}/live/flush={flush - 1}", _LIVE)
    live_slices(held, readings, flush, gap, idle_ms, now).write.mode("overwrite").parquet(f"{root}/live/flush={flush}")
    changed = spark.read.schema(_LIVE).parquet(f"{root}/live/flush={flush}").where("changed")
    dropped = held.where(F.col("due_ms") <= now)
    rows = changed.select(*COLUMNS, F.lit(False).alias("final")).unionByName(dropped.select(*COLUMNS, F.lit(True).alias("final")))
    rows.write.mode("overwrite").parquet(f"{root}/rows/flush={flush}")
    delete(spark, f"{root}/live/flush={flush - 2}")


def write_live_slices(root: str, gap: int = 30, idle_ms: int = IDLE_MS) -> Callable[[DataFrame, int], None]:
    def run(readings: DataFrame, batch: int) -> None:
        flush_slices(readings, root, batch, gap, idle_ms)

    return run


def with_heartbeat(readings: DataFrame) -> DataFrame:
    """The readings and, every second, a row without a device: there is a flush, and idle slices are dropped, when no reading comes."""
    ticks = readings.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    rows = readings.select(*DEVICE, "event_ms", "value")
    return rows.unionByName(ticks.select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))


def start_live_slices(readings: DataFrame, root: str, checkpoint: str, gap: int = 30, idle_ms: int = IDLE_MS, once: bool = False) -> StreamingQuery:
    """Flush every ``FLUSH_INTERVAL``, or a single time with ``once``: the heartbeat never ends, so a stream that ends by itself can only be counted in batches."""
    writer = with_heartbeat(readings).writeStream.foreachBatch(write_live_slices(root, gap, idle_ms))
    trigger = {"once": True} if once else {"processingTime": FLUSH_INTERVAL}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_view(spark: SparkSession, root: str) -> DataFrame:
    """Each slice with its totals over all openings, the number of ``openings``, and whether it is still ``live``."""
    rows = spark.read.schema(f"{_OUT}, flush long").parquet(f"{root}/rows")
    # of one opening the newest row has all that came; its final row repeats that
    openings = rows.groupBy(*KEYS, "opening").agg(
        F.max("value_count").alias("value_count"), F.max_by("value_sum", "flush").alias("value_sum"), F.max("event_ts").alias("event_ts"), F.bool_or("final").alias("final")
    )
    return openings.groupBy(*KEYS).agg(
        F.sum("value_count").alias("value_count"),
        exact_sum("value_sum").alias("value_sum"),
        F.max("event_ts").alias("event_ts"),
        F.count("*").alias("openings"),
        (~F.bool_and("final")).alias("live"),
    )
