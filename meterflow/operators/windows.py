"""Tumbling slices, window derivation, rollups and the merge of cumulative partials.

Device slices are the only aggregate computed from raw readings. Every other table is built from them, so raw
rows cross the network at most once, already reduced by Spark's partial aggregation.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions.slices import exact_sum, int_div, safe_avg, slice_index, utc_date
from meterflow.schemas import DERIVED_WINDOWS, DEVICE, DIRECT_WINDOWS, LEVEL_KEYS, SLICE


def window_slices(readings: DataFrame, gap: int) -> DataFrame:
    """Count, sum and freshest event time per device and slice of ``gap`` minutes.

    Rows without a complete device identity are left out explicitly: joins on these tables would infer the same
    filter on one side only, and the shuffle could then not be shared between the sides.
    """
    keyed = readings.dropna(subset=DEVICE).select(
        *DEVICE,
        utc_date("event_ms").alias("read_date"),
        F.lit(gap).alias("slice_gap"),
        slice_index("event_ms", gap).alias("slice_index"),
        "value",
        "event_ms",
    )
    return keyed.groupBy(*DEVICE, *SLICE).agg(
        F.count("*").alias("value_count"),
        exact_sum("value").alias("value_sum"),
        F.max("event_ms").alias("event_ts"),
    )


def _merge_sums(slices: DataFrame) -> DataFrame:
    return slices.groupBy(*DEVICE, *SLICE).agg(
        F.sum("value_count").alias("value_count"),
        exact_sum("value_sum").alias("value_sum"),
        F.max("event_ts").alias("event_ts"),
    )


def multi_window(readings: DataFrame, windows: list[int] | None = None) -> DataFrame:
    """All direct window sizes from one scan.

    Readings are reduced to the greatest common window first; only those partials are fanned out.
    """
    windows = windows or DIRECT_WINDOWS
    base = reduce(gcd, windows)
    return fan_out(window_slices(readings, base), windows)


def fan_out(slices: DataFrame, windows: list[int]) -> DataFrame:
    """Slices of one base size to every multiple in ``windows``.

    A device's slices of one day, at most 1440, are brought together first. All longer windows of that day are then
    added up in place: the fanned-out rows, one per window size, never cross the network, and the result is already
    partitioned by device and day for what follows. The number of partitions is given, because AQE would coalesce
    them by their size before the fan-out.
    """
    gap = F.explode(F.array(*[F.lit(w) for w in windows]))
    partitions = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = slices.repartition(partitions, *DEVICE, "read_date")
    wide = together.withColumnRenamed("slice_gap", "_base").withColumn("slice_gap", gap)
    index = int_div("slice_index", int_div("slice_gap", F.col("_base"))).cast("int")
    return _merge_sums(wide.withColumn("slice_index", index).drop("_base"))


def derive_window(slices: DataFrame, target: int, source: int = 30) -> DataFrame:
    """Longer slices by adding shorter ones; event time is not tracked for derived windows."""
    if target % source:
        raise ValueError(f"{target} is not a multiple of {source}")
    longer = slices.where(F.col("slice_gap") == source).select(
        *DEVICE,
        "read_date",
        F.lit(target).alias("slice_gap"),
        int_div("slice_index", target // source).cast("int").alias("slice_index"),
        "value_count",
        "value_sum",
        F.lit(0).cast("long").alias("event_ts"),
    )
    return _merge_sums(longer)


def all_windows(readings: DataFrame) -> DataFrame:
    """Direct and derived windows in one pass: the full device table."""
    table = multi_window(readings, [*DIRECT_WINDOWS, *DERIVED_WINDOWS])
    direct = F.col("slice_gap").isin(DIRECT_WINDOWS)
    return table.withColumn("event_ts", F.when(direct, F.col("event_ts")).otherwise(0))


def rollup(slices: DataFrame, level: str) -> DataFrame:
    """Sum of device averages and number of devices per household or house slice.

    The level average is therefore a mean of device means, not weighted by readings.
    """
    if level == "device":
        return slices
    return (
        slices.withColumn("_avg", safe_avg())
        .groupBy(*LEVEL_KEYS[level], *SLICE)
        .agg(F.count("*").alias("value_count"), exact_sum("_avg", 9).alias("value_sum"))
    )


def house_avg_watt(slices: DataFrame) -> DataFrame:
    """Mean device-slice average of each house."""
    return (
        slices.where(F.col("value_count") > 0)
        .groupBy("house_id")
        .agg(F.avg(F.col("value_sum") / F.col("value_count")).alias("house_avg"))
    )


def merge_latest(flush_log: DataFrame) -> DataFrame:
    """Current device slices from a log of cumulative flushes.

    The newest flush replaces count and sum, together; of flushes at the same time the one with the last batch identifier
    wins, then the larger count and sum, so the result depends on the log's content only. Event time only ever grows; first
    and last write time come from the same shuffle. Replayed or reordered batches cannot change the result.
    """
    newest = F.max(F.struct("flush_ts", "batch_id", "value_count", "value_sum"))
    merged = flush_log.groupBy(*DEVICE, *SLICE).agg(
        newest.alias("_newest"),
        F.max(F.coalesce("event_ts", F.lit(0).cast("long"))).alias("event_ts"),
        F.min("flush_ts").alias("first_written_at"),
    )
    return merged.select(
        *DEVICE,
        *SLICE,
        "_newest.value_count",
        "_newest.value_sum",
        "event_ts",
        "first_written_at",
        F.col("_newest.flush_ts").alias("updated_at"),
    )


def flush_log(readings: DataFrame, gap: int = 30) -> DataFrame:
    """Cumulative flushes of every slice: one in mid-slice and one at its end.

    Both are counted in one aggregation; a slice without early readings has no mid-slice flush.
    """
    gap_ms = gap * 60_000
    start = (F.col("event_ms") - F.col("event_ms") % gap_ms).alias("slice_start")
    early = (F.col("event_ms") % gap_ms) < gap_ms // 2
    sums = (
        readings.select(
            *DEVICE,
            utc_date("event_ms").alias("read_date"),
            F.lit(gap).alias("slice_gap"),
            slice_index("event_ms", gap).alias("slice_index"),
            start,
            "value",
            "event_ms",
            early.alias("early"),
        )
        .groupBy(*DEVICE, *SLICE, "slice_start")
        .agg(
            F.count_if("early").alias("early_count"),
            exact_sum(F.when(F.col("early"), F.col("value"))).alias("early_sum"),
            F.max(F.when(F.col("early"), F.col("event_ms"))).alias("early_ts"),
            F.count("*").alias("full_count"),
            exact_sum("value").alias("full_sum"),
            F.max("event_ms").alias("full_ts"),
        )
    )

    def flush(prefix: str, offset: int):
        return F.struct(
            (F.col("slice_start") + offset).alias("flush_ts"),
            F.col(f"{prefix}_count").alias("value_count"),
            F.col(f"{prefix}_sum").alias("value_sum"),
            F.col(f"{prefix}_ts").alias("event_ts"),
        )

    flushes = F.explode(F.array(flush("early", gap_ms // 2), flush("full", gap_ms)))
    return (
        sums.select(*DEVICE, *SLICE, flushes.alias("f"))
        .where(F.col("f.value_count") > 0)
        .select(
            *DEVICE,
            *SLICE,
            F.concat_ws("-", F.lit("w"), F.col("slice_gap"), F.col("f.flush_ts")).alias("batch_id"),
            "f.*",
        )
    )
