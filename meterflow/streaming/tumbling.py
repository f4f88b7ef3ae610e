"""Stateful stream path: event-time slices held in the state store, bounded by a watermark.

Only the base window is kept as state; longer windows are whole multiples of it and are derived from the view. A
reading older than the watermark is dropped before the sink (counted in ``numRowsDroppedByWatermark``); the partials
path has no such limit.

What the watermark has passed cannot change any more: ``close_slices`` moves it from the flush log to a table of final slices, once, and
leaves the newest flush of the open ones in the log.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterflow.functions.slices import slice_index, utc_date
from meterflow.operators.windows import fan_out, merge_latest
from meterflow.schemas import DEVICE
from meterflow.session import delete
from meterflow.streaming.partials import FLUSH_INTERVAL, read_or_empty

LATENESS = "3 hours"


def tumbling(readings: DataFrame, base: int = 1, lateness: str = LATENESS) -> DataFrame:
    """Cumulative totals of every base window; in update mode each trigger emits the changed ones."""
    timed = readings.withColumn("event_time", F.timestamp_millis("event_ms")).withWatermark("event_time", lateness)
    sums = timed.groupBy(F.window("event_time", f"{base} minutes").alias("slot"), *DEVICE).agg(
        F.count("*").alias("value_count"), F.sum("value").alias("value_sum"), F.max("event_ms").alias("event_ts")
    )
    start = F.unix_millis("slot.start")
    return sums.select(
        *DEVICE,
        utc_date(start).alias("read_date"),
        F.lit(base).alias("slice_gap"),
        slice_index(start, base).alias("slice_index"),
        "value_count",
        "value_sum",
        "event_ts",
    )


def write_flushes(root: str) -> Callable[[DataFrame, int], None]:
    """Changed slices of one trigger as flush-log rows; the batch number orders them."""

    def flush(changed: DataFrame, batch: int) -> None:
        rows = changed.withColumn("flush_ts", F.lit(batch).cast("long")).withColumn("batch_id", F.lit(str(batch)))
        rows.write.mode("overwrite").parquet(f"{root}/batch={batch}")

    return flush


def start_tumbling(
    readings: DataFrame,
    root: str,
    checkpoint: str,
    base: int = 1,
    lateness: str = LATENESS,
    available_now: bool = False,
) -> StreamingQuery:
    writer = (
        tumbling(readings, base, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(write_flushes(root))
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": FLUSH_INTERVAL}
    return writer.trigger(**trigger).start()


_FLUSHES = (
    "house_id int, household_id int, plug_id int, read_date date, slice_gap int, slice_index int, value_count long, value_sum double, "
    "event_ts long, flush_ts long, batch_id string, batch long"
)


def _ends_ms() -> Column:
    minutes = (F.col("slice_index").cast("long") + 1) * F.col("slice_gap")
    return F.unix_date("read_date").cast("long") * 86_400_000 + minutes * 60_000


def _final(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The final slices, and the watermark up to which they have been closed."""
    final = read_or_empty(spark, f"{root}-final", f"{_FLUSHES}, closed long")
    upto = final.agg(F.max("closed")).first()[0]
    return final.drop("closed", "batch"), -1 if upto is None else upto


def watermark_ms(query: StreamingQuery) -> int | None:
    """The watermark of the last finished trigger."""
    seen = [p["eventTime"]["watermark"] for p in query.recentProgress if p.get("eventTime", {}).get("watermark")]
    return int(datetime.fromisoformat(seen[-1].replace("Z", "+00:00")).timestamp() * 1000) if seen else None


def close_slices(spark: SparkSession, root: str, watermark: int) -> None:
    """Write the slices that ended by the watermark as final, by day, and cut the log down to the newest flush of the others.

    Run between triggers. Repeating a closing that broke off changes nothing: final rows go to the folder of their watermark, and the view takes no
    slice from the log that has been closed.
    """
    _, upto = _final(spark, root)
    log = read_or_empty(spark, root, _FLUSHES)
    last = log.agg(F.max("batch")).first()[0]
    if last is None or watermark <= upto:
        return
    newest = merge_latest(log.where(_ends_ms() > upto)).withColumns({"flush_ts": F.col("updated_at"), "batch_id": F.col("updated_at").cast("string")})
    rows = newest.drop("first_written_at", "updated_at")
    done = rows.where(_ends_ms() <= watermark)
    done.hint("rebalance", "read_date").write.mode("overwrite").partitionBy("read_date").parquet(f"{root}-final/closed={watermark}")
    rows.where(_ends_ms() > watermark).write.mode("overwrite").parquet(f"{root}-open")
    open_ = spark.read.parquet(f"{root}-open")
    open_.write.mode("overwrite").parquet(f"{root}/batch={last}")
    for batch in [r[0] for r in log.where(F.col("batch") < last).select("batch").distinct().collect()]:
        delete(spark, f"{root}/batch={batch}")


def tumbling_view(spark: SparkSession, root: str, windows: list[int]) -> DataFrame:
    """All window sizes from the final slices and the newest value of every open base window."""
    final, upto = _final(spark, root)
    open_ = read_or_empty(spark, root, _FLUSHES).drop("batch").where(_ends_ms() > upto)
    return fan_out(merge_latest(open_.unionByName(final)), windows)
