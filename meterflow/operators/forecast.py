"""Forecasts from stored slices, comparison of forecast and actual series, and forecast quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions.slices import round2, safe_avg
from meterflow.schemas import LEVEL_KEYS, SLICE


def median_forecast(slices: DataFrame, level: str) -> DataFrame:
    """Mean of a slice's average and the median of its day, or the average alone if the median is not positive.

    The window holds one entity's slices of one day: at most 1440 rows.
    """
    keys = LEVEL_KEYS[level]
    day = Window.partitionBy(*keys, "read_date", "slice_gap")
    history = slices.where(F.col("value_count") > 0).withColumn("slice_avg", F.col("value_sum") / F.col("value_count"))
    median = F.median("slice_avg").over(day)
    value = F.when(F.col("day_median") > 0, (F.col("slice_avg") + F.col("day_median")) / 2).otherwise(F.col("slice_avg"))
    return history.withColumn("day_median", median).select(
        F.lit(level).alias("level"), *keys, *SLICE, "slice_avg", "day_median", round2(value).alias("forecast_value")
    )


def slice_profile(slices: DataFrame, level: str) -> DataFrame:
    """Mean of each slice-of-day over all days."""
    return slices.groupBy(*LEVEL_KEYS[level], "slice_gap", "slice_index").agg(F.avg(safe_avg()).alias("profile_avg"))


def profile_forecast(slices: DataFrame, level: str, history: DataFrame | None = None) -> DataFrame:
    """Every actual slice with its profile value.

    ``history`` may hold more days than ``slices``: a day filter narrows the answer, not the profile.
    """
    keys = [*LEVEL_KEYS[level], "slice_gap", "slice_index"]
    profile = slice_profile(slices if history is None else history, level)
    return slices.withColumn("actual_avg", safe_avg()).join(profile, keys).select(
        *LEVEL_KEYS[level], *SLICE, "actual_avg", F.col("profile_avg").alias("forecast_avg")
    )


def union_series(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Both series one after the other, duplicates kept."""
    return actual.withColumn("series", F.lit("actual")).unionByName(forecast.withColumn("series", F.lit("forecast")))


def align_series(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the labels of both series; the absent side is zero."""
    joined = actual.join(forecast, keys, "full")
    return joined.select(
        *keys,
        F.coalesce("actual_avg", F.lit(0.0)).alias("actual_avg"),
        F.coalesce("forecast_avg", F.lit(0.0)).alias("forecast_avg"),
    )


def actual_vs_forecast(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Only labels present in both series."""
    return actual.join(forecast, keys).select(*keys, "actual_avg", "forecast_avg")


def sorted_labels(labels: DataFrame, key: str = "house_id") -> DataFrame:
    """Zero-based position of each label in text order, per house.

    The series is already reduced to one row per slice, so its length is bounded by the calendar.
    """
    order = Window.partitionBy(key).orderBy("label")
    return labels.withColumn("position", F.row_number().over(order) - 1)


def series_stats(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and population spread of a displayed series."""
    return series.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("variance"),
        F.stddev_pop(value).alias("standard_deviation"),
    )


def forecast_quality(house_slices: DataFrame, version: str = "v0") -> DataFrame:
    """Per window size: spread of actual and forecast values together, and their standardised squared error.

    Standardising both sides with the same mean and deviation leaves ``(a - f)^2 / variance``, so the error needs
    no second pass over the joined rows.
    """
    pairs = profile_forecast(house_slices, "house")
    both = pairs.select(
        "slice_gap",
        F.pow(F.col("actual_avg") - F.col("forecast_avg"), 2).alias("squared"),
        F.explode(F.array("actual_avg", "forecast_avg")).alias("avg"),
    )
    return both.groupBy("slice_gap").agg(
        F.lit(version).alias("version"),
        (F.count("*") / 2).cast("long").alias("count"),
        F.avg("avg").alias("mean"),
        F.var_samp("avg").alias("variance"),
        F.stddev_samp("avg").alias("standard_deviation"),
        (F.avg("squared") / F.var_samp("avg")).alias("mse"),
    )
