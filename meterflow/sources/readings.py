"""Raw readings: parsing of text lines, file and stream readers, row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions.slices import gateway_of, seconds_to_millis

# Line layout `_,timestamp,value,property,plug,household,house`; property 1 marks a load reading.
LINE_FIELDS = 7
LOAD_PROPERTY = 1


def split_fields(lines: DataFrame, separator: str, column: str = "value") -> DataFrame:
    """Lines as one array column ``fields``.

    Filters on single fields would be pushed below the split and repeat it for each of them; they do not pass the
    one-element explode, so every line is split once.
    """
    return lines.select(F.explode(F.array(F.split(F.col(column), separator))).alias("fields"))


def parse_readings(lines: DataFrame, ts_unit: str = "s", column: str = "value") -> DataFrame:
    """Text lines to readings; short and unparsable lines are skipped.

    The leading field is kept as ``event_id`` when it is a number: it only breaks ties in time order.
    """
    parts = split_fields(lines, ",", column).where(F.size("fields") >= LINE_FIELDS)
    fields = parts.select(*[F.trim(F.col("fields")[i]).alias(f"f{i}") for i in range(LINE_FIELDS)])
    stamp = F.col("f1").try_cast("long")
    typed = fields.select(
        F.col("f0").try_cast("long").alias("event_id"),
        (seconds_to_millis(stamp) if ts_unit == "s" else stamp).alias("event_ms"),
        F.col("f2").try_cast("double").alias("value"),
        F.col("f3").try_cast("int").alias("property"),
        F.col("f4").try_cast("int").alias("plug_id"),
        F.col("f5").try_cast("int").alias("household_id"),
        F.col("f6").try_cast("int").alias("house_id"),
    )
    return typed.dropna(subset=[c for c in typed.columns if c != "event_id"])


def read_readings(spark: SparkSession, path: str, ts_unit: str = "s") -> DataFrame:
    return parse_readings(spark.read.text(path), ts_unit)


def stream_readings(spark: SparkSession, path: str, ts_unit: str = "s", max_files: int | None = None) -> DataFrame:
    """Files arriving in a landing folder; ``max_files`` bounds one micro-batch instead of dropping rows."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_readings(reader.load(path), ts_unit)


def stream_topic(spark: SparkSession, servers: str, topic: str, ts_unit: str = "s", max_offsets: int = 50_000) -> DataFrame:
    """The same lines from a message topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return parse_readings(raw.select(F.col("value").cast("string").alias("value")), ts_unit)


def is_load() -> Column:
    return F.col("property") == LOAD_PROPERTY


def filter_load(readings: DataFrame) -> DataFrame:
    return readings.where(is_load())


def filter_shard(readings: DataFrame, houses: list[int]) -> DataFrame:
    """Rows of one gateway's houses."""
    return readings.where(F.col("house_id").isin(houses))


def assign_gateway(readings: DataFrame) -> DataFrame:
    return readings.withColumn("gateway_id", gateway_of("house_id"))


def ingest_counters(readings: DataFrame, houses: list[int]) -> DataFrame:
    """Per gateway: lines seen, load readings outside the shard, readings passed on."""
    in_shard = F.col("house_id").isin(houses)
    return (
        assign_gateway(readings)
        .groupBy("gateway_id")
        .agg(
            F.count("*").alias("received"),
            F.count_if(is_load() & in_shard).alias("emitted"),
            F.count_if(is_load() & ~in_shard).alias("filtered"),
        )
    )
