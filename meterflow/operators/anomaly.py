"""Scoring of single readings against each device's own moving baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.operators.folds import cooldown, ewma_baseline
from meterflow.schemas import DEVICE

READING_ORDER = ["event_ms", "event_id"]


@dataclass(frozen=True)
class Detector:
    """Default weights and limits of the detector."""

    alpha: float = 0.3
    z_threshold: float = 3.0
    hard_ceiling: float = 2500.0
    warmup: int = 20
    min_std: float = 1.0
    cooldown_ms: int = 60_000


def reason_text(kind: Column, value: Column, mean: Column, z: Column, ceiling: float) -> Column:
    """One sentence per kind of result."""
    over = F.format_string("reading %.0fW exceeds absolute ceiling %.0fW", value, F.lit(float(ceiling)))
    far = F.format_string("reading %.0fW is %.1f sigma from baseline %.0fW", value, z, mean)
    return F.when(kind == "HARD_CEILING", over).when(kind == "Z_SCORE", far).otherwise(F.lit("within baseline"))


def classify(scored: DataFrame, detector: Detector) -> DataFrame:
    """Ceiling first, also while warming up; then distance from the baseline in standard deviations."""
    value, mean = F.col("value"), F.col("mean_before")
    std = F.greatest(F.sqrt("var_before"), F.lit(detector.min_std))
    distance = F.when(F.col("seen_before") >= detector.warmup, (value - mean) / std).otherwise(F.lit(0.0))
    over = value >= detector.hard_ceiling if detector.hard_ceiling > 0 else F.lit(False)
    kind = F.when(over, "HARD_CEILING").when(F.abs("_distance") >= detector.z_threshold, "Z_SCORE").otherwise("NORMAL")
    severity = (
        F.when(F.col("type") == "HARD_CEILING", "CRITICAL").when(F.col("type") == "Z_SCORE", "WARNING").otherwise("NONE")
    )
    return (
        scored.withColumn("_distance", distance)
        .withColumn("type", kind)
        .withColumn("z_score", F.when(F.col("type") == "HARD_CEILING", 0.0).otherwise(F.col("_distance")))
        .withColumn("severity", severity)
        .withColumn("anomaly", F.col("type") != "NORMAL")
        .drop("_distance")
    )


def score_readings(readings: DataFrame, detector: Detector, partitions: int | None = None) -> DataFrame:
    """Every reading with the baseline it was scored against and the verdict."""
    scored = ewma_baseline(readings, DEVICE, READING_ORDER, detector.alpha, partitions=partitions)
    return classify(scored, detector)


def with_reason(scored: DataFrame, detector: Detector) -> DataFrame:
    """Adds ``reason``, the verdict as a sentence."""
    text = reason_text(F.col("type"), F.col("value"), F.col("mean_before"), F.col("z_score"), detector.hard_ceiling)
    return scored.withColumn("reason", text)


def fire_alerts(scored: DataFrame, detector: Detector, partitions: int | None = None) -> DataFrame:
    """Anomalies with ``fired``; suppressed ones do not extend a device's cooldown.

    Only anomalies reach the fold. Event time stands for the wall clock.
    """
    return cooldown(with_reason(scored.where("anomaly"), detector), DEVICE, READING_ORDER, detector.cooldown_ms, partitions=partitions)
