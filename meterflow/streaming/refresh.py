"""Metadata and forecast quality kept up to date by micro-batches, without reading the whole history again.

Quality. A slice of the day (house, window size, index) has one value a day. Its values over all days have a number, a mean and a sum of squared
deviations, which can be merged and also taken apart. All quality figures of a window size follow from those of its slots:
the profile is a slot's mean, the squared error its squared deviations. A refresh reads the state before it and the days
that changed, nothing else: it takes away what those days said before and merges what they say now.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions.slices import safe_avg, utc_date
from meterflow.operators.windows import rollup
from meterflow.schemas import DEVICE, LEVEL_KEYS
from meterflow.streaming.partials import partials_view, read_or_empty, write_partials

SLOT = ["house_id", "slice_gap", "slice_index"]
_LEAF = "house_id int, slice_gap int, slice_index int, avg double, read_date date, batch long"
_STATE = "house_id int, slice_gap int, slice_index int, n long, mean double, m2 double, batch long"


# -- quality ------------------------------------------------------------------------------------------------------


def merge_moments(states: DataFrame) -> DataFrame:
    """States of the same slot added up; those with a negative ``n`` are taken away."""
    n, weighted = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    mean = weighted / n
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    merged = states.groupBy(*SLOT).agg(n.alias("n"), mean.alias("mean"), F.greatest(spread, F.lit(0.0)).alias("m2"))
    return merged.where(F.col("n") > 0)


def as_state(leaves: DataFrame, sign: int = 1) -> DataFrame:
    """One value each as a state, or as one to take away."""
    return leaves.select(*SLOT, F.lit(sign).cast("long").alias("n"), F.col("avg").alias("mean"), F.lit(0.0).alias("m2"))


def quality_of(state: DataFrame, version: str = "v0") -> DataFrame:
    """The figures of ``forecast_quality`` from the slots' moments: every slot holds ``n`` values and ``n`` times its mean."""
    n, mean, m2 = F.col("n"), F.col("mean"), F.col("m2")
    count, total = F.sum(n), F.sum(n * mean)
    middle = total / count
    # both series together: deviations inside the slots, and twice those of the slots' means
    spread = F.sum(m2) + 2 * (F.sum(n * mean * mean) - count * middle * middle)
    variance = F.when(2 * count > 1, spread / (2 * count - 1))
    return state.groupBy("slice_gap").agg(
        F.lit(version).alias("version"),
        count.alias("count"),
        middle.alias("mean"),
        variance.alias("variance"),
        F.sqrt(variance).alias("standard_deviation"),
        (F.sum(m2) / count / variance).alias("mse"),
    )


def newest_state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    states = read_or_empty(spark, f"{root}/state", _STATE)
    if before is not None:
        states = states.where(F.col("batch") < before)
    last = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == F.lit(last)).drop("batch")


def refresh_quality(spark: SparkSession, root: str, house_days: DataFrame, batch: int) -> None:
    """Bring the state up to date with the whole current house slices of the days that changed.

    Leaves and state are written under the batch number; a refresh that runs again starts from what was there before it.
    """
    now = house_days.select(*SLOT, safe_avg().alias("avg"), "read_date")
    now.write.mode("overwrite").parquet(f"{root}/leaves/batch={batch}")
    now = spark.read.schema(_LEAF).parquet(f"{root}/leaves").where(F.col("batch") == batch)
    days = [r[0] for r in now.select("read_date").distinct().collect()]  # of one batch, at most a calendar's
    earlier = spark.read.schema(_LEAF).parquet(f"{root}/leaves").where((F.col("batch") < batch) & F.col("read_date").isin(days))
    before = earlier.groupBy(*SLOT, "read_date").agg(F.max_by("avg", "batch").alias("avg"))
    parts = [newest_state(spark, root, batch), as_state(before, -1), as_state(now)]
    merge_moments(reduce(DataFrame.unionByName, parts)).write.mode("overwrite").parquet(f"{root}/state/batch={batch}")


def write_and_refresh(root: str, windows: list[int]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: partial slices of the readings, then the quality of the days that they belong to."""
    write = write_partials(f"{root}/partials", windows)

    def run(readings: DataFrame, batch: int) -> None:
        spark = readings.sparkSession
        write(readings, batch)
        days = [r[0] for r in readings.select(utc_date("event_ms").alias("d")).distinct().collect()]
        if days:
            current = partials_view(spark, f"{root}/partials").where(F.col("read_date").isin(days))
            refresh_quality(spark, f"{root}/quality", rollup(current, "house"), batch)

    return run


# -- topology -----------------------------------------------------------------------------------------------------


def entity_days(readings: DataFrame) -> DataFrame:
    """Stream of ``level``, entity and day, each once: the state store knows the pairs that have been seen.

    Pairs are reduced inside a micro-batch before they meet the state, whose size entities and calendar bound.
    """
    none = F.lit(None).cast("int")

    def entity(level: str) -> Column:
        return F.struct(F.lit(level).alias("level"), *[(F.col(k) if k in LEVEL_KEYS[level] else none).alias(k) for k in DEVICE])

    days = readings.dropna(subset=DEVICE).select(*DEVICE, utc_date("event_ms").alias("read_date"))
    each = days.select("read_date", F.explode(F.array(*[entity(level) for level in LEVEL_KEYS])).alias("e"))
    return each.select("e.*", "read_date").dropDuplicates(["level", *DEVICE, "read_date"])
