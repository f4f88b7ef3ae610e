"""The driver's ``events`` table seen as plug readings.

``wide`` spreads users over 40 houses (many sparse devices); ``dense`` folds them into five houses so that
every device has a long history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions.slices import int_div
from meterflow.session import use_utc

# Event types standing for the plugs 0..3; any other type is not a load reading.
PLUG_EVENT_TYPES = ["click", "view", "purchase", "signup"]
NOT_LOAD = "error"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_readings(events: DataFrame, layout: str = "wide") -> DataFrame:
    """Map event columns to reading columns; works on batch and streaming input."""
    user = F.col("user_id")
    if layout == "wide":
        house, household = user % 40, int_div(user, 40)
    elif layout == "dense":
        house, household = user % 5, int_div(user, 5) % 2
    else:
        raise ValueError(f"unknown layout {layout!r}")
    kinds = F.array(*[F.lit(kind) for kind in PLUG_EVENT_TYPES])
    return events.select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_ms"),
        "value",
        (F.col("event_type") != NOT_LOAD).cast("int").alias("property"),
        (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("plug_id"),
        household.cast("int").alias("household_id"),
        house.cast("int").alias("house_id"),
    )


def driver_readings(spark: SparkSession, sf_dir: str, layout: str = "wide") -> DataFrame:
    return as_readings(load_table(spark, sf_dir, "events"), layout)


EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_driver_readings(spark: SparkSession, sf_dir: str, layout: str = "wide") -> DataFrame:
    """The same table as a stream, be it one file or a folder of files."""
    reader = use_utc(spark).readStream.schema(EVENTS_SCHEMA)
    return as_readings(reader.parquet(f"{sf_dir}/events*.parquet"), layout)
