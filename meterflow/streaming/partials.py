"""Default stream path: stateless partials per micro-batch, any age accepted, safe to replay.

Each micro-batch is reduced to partial slices and written to the folder of its number, which a replay overwrites. Sums of
partials equal the batch result whatever order the readings arrive in, and no watermark can drop a late one. An ordinary job
folds old batches into a table by window size and day; every row of it says up to which batch its day has been folded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterflow.functions.slices import exact_sum
from meterflow.operators.windows import multi_window
from meterflow.schemas import DEVICE, SLICE

FLUSH_INTERVAL = "60 seconds"
DAY = ["slice_gap", "read_date"]
_ROWS = "house_id int, household_id int, plug_id int, slice_index int, value_count long, value_sum double, event_ts long, slice_gap int, read_date date"


def write_partials(root: str, windows: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    def flush(readings: DataFrame, batch: int) -> None:
        multi_window(readings, windows).write.mode("overwrite").parquet(f"{root}/batches/batch={batch}")

    return flush


def start_partials(
    readings: DataFrame,
    root: str,
    checkpoint: str,
    windows: list[int] | None = None,
    available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Flush every ``interval``, or once over all waiting data with ``available_now``."""
    writer = readings.writeStream.foreachBatch(write_partials(root, windows)).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def _sum(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*DEVICE, *SLICE).agg(
        F.sum("value_count").alias("value_count"), exact_sum("value_sum").alias("value_sum"), F.max("event_ts").alias("event_ts")
    )


def _parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The folded days with ``upto``, and the partials of batches that are not in them, with ``batch``."""
    folded = read_or_empty(spark, f"{root}/folded", f"{_ROWS}, upto long")
    days = folded.groupBy(*DAY).agg(F.max("upto").alias("upto"))
    batches = read_or_empty(spark, f"{root}/batches", f"{_ROWS}, batch long")
    fresh = batches.join(days, DAY, "left").where(F.col("upto").isNull() | (F.col("batch") > F.col("upto"))).drop("upto")
    return folded, fresh


def partials_view(spark: SparkSession, root: str) -> DataFrame:
    """Current device slices: the folded days plus all batches after them."""
    folded, fresh = _parts(spark, root)
    return _sum(folded.drop("upto").unionByName(fresh.drop("batch")))


def compact_partials(spark: SparkSession, root: str) -> int:
    """Fold all batches so far; returns the number of the last one, -1 if there is none.

    Only days with new partials are written again, each as a whole, so a job that dies half-way leaves days that are folded and days that are
    not. Batches below the returned number may be removed when no reader needs them.
    """
    folded, fresh = _parts(spark, root)
    last = read_or_empty(spark, f"{root}/batches", "batch long").agg(F.max("batch")).first()[0]
    if last is None:
        return -1
    touched = fresh.where(F.col("batch") <= last).select(*DAY).distinct()
    rows = folded.join(touched, DAY, "left_semi").drop("upto").unionByName(fresh.where(F.col("batch") <= last).drop("batch"))
    whole = _sum(rows).withColumn("upto", F.lit(last).cast("long")).hint("rebalance", *DAY)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*DAY).parquet(f"{root}/folded")
    return last
