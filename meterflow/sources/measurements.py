"""Measurement inputs: metric series, load steps, alert logs, labels, container and component statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.sources.readings import split_fields

# Columns of the tab-separated metric series, and what an alert log line looks like.
SERIES_COLUMNS = ["epoch", "cap", "lat", "ack", "tup", "gwcap", "wan_rx"]
ALERT_MARK = " ALERT "
ALERT_TIME = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z)"
ALERT_IDS = r"house=(\d+)\s+hh=(\d+)\s+plug=(\d+)"
TOTAL_ROW = "TOTAL_CPU_PERCENT"

_SPIKE = "array<struct<ts: bigint, houseId: int, householdId: int, plugId: int, value: double>>"
TRUTH_SCHEMA = f"start bigint, `end` bigint, spikes {_SPIKE}"
_COMPONENT = "executors: bigint, tasks: bigint, emitted: bigint, transferred: bigint"
STATS_SCHEMA = (
    f"name string, spouts array<struct<spoutId: string, {_COMPONENT}>>, bolts array<struct<boltId: string, {_COMPONENT}>>"
)


def number_or_null(text: Column) -> Column:
    """Not-a-number counts as missing."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_series(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated samples; the header and lines without a time are dropped, other gaps become null."""
    cells = [F.get("fields", F.lit(i)) for i in range(len(SERIES_COLUMNS))]
    parts = split_fields(lines, "\t", column)
    typed = parts.select(*[number_or_null(cell).alias(c) for cell, c in zip(cells, SERIES_COLUMNS)])
    return typed.where(F.col("epoch").isNotNull())


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return parse_series(spark.read.text(path))


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Load steps ``houses, step_start, step_end`` from a tab-separated file with a header."""
    raw = spark.read.option("sep", "\t").option("header", True).schema("houses string, step_start string, step_end string").csv(path)
    return raw.select(
        F.col("houses").try_cast("double").cast("int").alias("houses"),
        F.col("step_start").try_cast("double").alias("step_start"),
        F.col("step_end").try_cast("double").alias("step_end"),
    )


def parse_alert_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Ids and time of alert lines; lines without ids are skipped, a missing time stays null."""
    line = F.col(column)
    stamp = F.regexp_extract(F.trim(line), ALERT_TIME, 1)
    found = lines.where(line.contains(ALERT_MARK) & line.rlike(ALERT_IDS))
    return found.select(
        *[c for c in lines.columns if c != column],
        F.regexp_extract(line, ALERT_IDS, 1).cast("int").alias("house_id"),
        F.regexp_extract(line, ALERT_IDS, 2).cast("int").alias("household_id"),
        F.regexp_extract(line, ALERT_IDS, 3).cast("int").alias("plug_id"),
        (F.unix_micros(F.try_to_timestamp(F.when(stamp != "", stamp))) / 1e6).alias("ts"),
    )


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    """Alerts with ``alert_id`` in log order: files by name, lines in file order, numbered from 0.

    The numbers are running sums over file blocks, whose counts are few.
    """
    lines = in_file_order(spark.read.text(path), "_place")
    block = [F.col("_place.file").alias("_file"), F.col("_place.block").alias("_block")]
    alerts = parse_alert_log(lines.select("*", *block))
    counts = alerts.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_place"))
    numbered = alerts.withColumn("_within", within).join(starts, ["_file", "_block"])
    return numbered.select((F.col("_start") + F.col("_within") - 1).alias("alert_id"), *[c for c in alerts.columns if not c.startswith("_")])


def parse_ground_truth(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row per labelled spike, with its place in the document and the labelled period."""
    kept = [c for c in documents.columns if c != column]
    doc = documents.select(*kept, F.from_json(column, TRUTH_SCHEMA).alias("d"))
    spikes = doc.select(*kept, "d.start", "d.end", F.posexplode("d.spikes").alias("position", "s"))
    return spikes.select(
        *kept,
        "start",
        "end",
        "position",
        F.col("s.ts").alias("ts"),
        F.col("s.houseId").alias("house_id"),
        F.col("s.householdId").alias("household_id"),
        F.col("s.plugId").alias("plug_id"),
        F.col("s.value").alias("value"),
    )


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return parse_ground_truth(spark.read.text(path, wholetext=True))


def read_container_stats(spark: SparkSession, path: str) -> DataFrame:
    schema = "container string, cpu_perc string, mem_usage string, net_io string, block_io string"
    return spark.read.option("header", True).schema(schema).csv(path)


def container_rows(stats: DataFrame) -> DataFrame:
    """Containers without the row that carries the total."""
    return stats.where(F.col("container") != TOTAL_ROW)


def container_total(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("container") == TOTAL_ROW).select(
        F.regexp_replace("cpu_perc", "%", "").try_cast("double").alias("total_cpu")
    )


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).schema("metric string, window string, value string").csv(path)
    return last_metrics(typed_metrics(in_file_order(raw, "_order")), "_order")


def in_file_order(scan: DataFrame, name: str) -> DataFrame:
    """Adds a sortable place for each row of a file scan: file, start of the block, position within the task.

    Spark deals blocks to tasks by size, so the position alone says nothing about the order of two blocks. A block is read by one
    task from its start to its end.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return scan.select("*", place.alias(name))


def typed_metrics(raw: DataFrame) -> DataFrame:
    """Metric values as numbers; unreadable ones become null but keep their row."""
    return raw.withColumn("value", F.col("value").try_cast("double"))


def last_metrics(typed: DataFrame, order: str) -> DataFrame:
    """One row per metric and window: the last one counts."""
    return typed.groupBy("metric", "window").agg(F.max(F.struct(order, "value"))["value"].alias("value"))


def parse_component_stats(documents: DataFrame, column: str = "value") -> DataFrame:
    """Per-component counters, sources and processors alike, one row each."""
    doc = documents.select(F.from_json(column, STATS_SCHEMA).alias("d"))

    def flat(array: str, kind: str, identity: str) -> DataFrame:
        each = doc.select(F.col("d.name").alias("topology"), F.explode(f"d.{array}").alias("c"))
        return each.select(
            "topology",
            F.lit(kind).alias("type"),
            F.col(f"c.{identity}").alias("component"),
            "c.executors",
            "c.tasks",
            "c.emitted",
            "c.transferred",
        )

    return flat("spouts", "spout", "spoutId").unionByName(flat("bolts", "bolt", "boltId"))


def read_component_stats(spark: SparkSession, path: str) -> DataFrame:
    return parse_component_stats(spark.read.text(path, wholetext=True))


def latest_snapshot(spark: SparkSession, path_glob: str, file_format: str = "csv", **options: str) -> DataFrame:
    """Rows of the newest file matching the pattern.

    Only file names and times are compared to find it: one row per file, no file content.
    """
    files = spark.read.format("binaryFile").load(path_glob).select("path", "modificationTime")
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first().path
    if newest is None:
        raise FileNotFoundError(path_glob)
    return spark.read.format(file_format).options(**options).load(newest)
