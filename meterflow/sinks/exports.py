"""Exports: series as wide CSV, gateway envelopes, comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.sources.batches import build_envelopes


def export_lines(series: DataFrame, key: str = "house_id") -> DataFrame:
    """Per house: labels, averages and statistics as comma-separated lines, numbers with three decimals.

    ``series`` is what a display shows, a range of days chosen by the caller: a line holds one house's slices of that
    range. With a ``forecast`` column there is one more line, the mean squared error of the forecast.
    """
    error = [F.format_string("%.3f", F.avg((F.col("avg") - F.col("forecast")) ** 2)).alias("mse")] if "forecast" in series.columns else []
    points = F.array_sort(F.collect_list(F.struct("label", "avg")))
    stats = series.groupBy(key).agg(
        points.alias("points"),
        F.count("*").alias("count"),
        F.format_string("%.3f", F.avg("avg")).alias("mean"),
        F.format_string("%.3f", F.var_pop("avg")).alias("variance"),
        F.format_string("%.3f", F.stddev_pop("avg")).alias("sd"),
        *error,
    )
    lines = F.array(
        F.concat_ws(",", F.lit("House"), F.col("points.label")),
        F.concat_ws(",", F.col(key).cast("string"), F.transform("points.avg", lambda v: F.format_string("%.3f", F.floor(v * 1000 + 0.5) / 1000))),
        F.concat(F.lit("Count,"), F.col("count")),
        F.concat(F.lit("Mean,"), F.col("mean")),
        F.concat(F.lit("Variance,"), F.col("variance")),
        F.concat(F.lit("Standard deviation,"), F.col("sd")),
        *([F.concat(F.lit("MSE,"), F.col("mse"))] if error else []),
    )
    return stats.select(key, F.posexplode(lines).alias("line_no", "line"))


def export_csv(series: DataFrame, path: str, key: str = "house_id") -> None:
    """One folder per house, lines in order."""
    lines = export_lines(series, key).repartition(key).sortWithinPartitions(key, "line_no")
    lines.select(key, F.col("line").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_batches(flush_log: DataFrame, path: str, mode: str = "append") -> None:
    """Envelopes as compressed JSON lines."""
    build_envelopes(flush_log).write.mode(mode).option("compression", "gzip").json(path)


def write_comparison(comparison: DataFrame, path: str) -> None:
    comparison.orderBy("metric", "window").write.mode("overwrite").option("header", True).csv(path)
