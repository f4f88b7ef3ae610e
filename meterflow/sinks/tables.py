"""Stored tables: layout, creation, replay-safe logs, current views and compaction.

Parquet has no row updates. Writers therefore only add whole directories (one per batch, overwritten when the same
batch is replayed) and readers reduce the log to its current rows with one shuffle on the primary key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.functions.slices import render_key
from meterflow.operators.windows import merge_latest, rollup
from meterflow.schemas import FORECAST, LEVEL_KEYS, NOTIFICATION, QUALITY, SLICE, slice_schema

PARTITIONING = ["slice_gap", "read_date"]
JDBC_BATCH = 500


def table_schemas() -> dict[str, T.StructType]:
    return {
        **{level: slice_schema(level) for level in LEVEL_KEYS},
        "forecast": FORECAST,
        "forecast_meta_data": QUALITY,
        "notification": NOTIFICATION,
    }


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise
    return True


def init_tables(spark: SparkSession, root: str) -> list[str]:
    """Create every table that does not exist yet; existing ones stay as they are."""
    created = []
    for name, schema in table_schemas().items():
        if not _exists(spark, f"{root}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
            created.append(name)
    return created


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(table_schemas()[name]).parquet(f"{root}/{name}")


def write_slices(slices: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Slices partitioned by window size and day, the two columns every query filters on.

    The rebalance hint brings rows of one partition together and lets AQE split a busy day by size, so neither
    many small files nor one huge task results. ``overwrite`` only replaces the days present in ``slices``.
    """
    arranged = slices.hint("rebalance", *PARTITIONING)
    arranged.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONING).parquet(path)


def write_levels(device: DataFrame, root: str) -> None:
    """The device, household and house tables of a set of device slices; rollups are taken from what is stored."""
    write_slices(device, f"{root}/device")
    stored = read_levels(device.sparkSession, root, ["device"])["device"]
    for level in ("household", "house"):
        write_slices(rollup(stored, level), f"{root}/{level}")


def read_levels(spark: SparkSession, root: str, levels: list[str] | None = None) -> dict[str, DataFrame]:
    """Stored level tables by name. Window size and day are folders: a request reads the ones that it asks for."""
    return {level: spark.read.schema(slice_schema(level)).parquet(f"{root}/{level}") for level in levels or LEVEL_KEYS}


def write_notifications(notifications: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Notifications by level and day."""
    by = ["level", "read_date"]
    notifications.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTIFICATION).parquet(path)


def append_log(rows: DataFrame, log_path: str, batch: int) -> None:
    """One directory per batch: writing a batch again replaces it."""
    rows.write.mode("overwrite").parquet(f"{log_path}/batch={batch}")


def device_view(flush_log: DataFrame) -> DataFrame:
    """Current device rows: newest totals, first and last write time."""
    return merge_latest(flush_log)


def latest_rows(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest whole row per primary key; of rows equally new, the one whose other columns are largest."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return log.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def level_view(log: DataFrame, level: str) -> DataFrame:
    """Current household or house rows."""
    return latest_rows(log, [*LEVEL_KEYS[level], *SLICE], ["updated_at"])


def forecast_rows(forecast: DataFrame, level: str, updated_at: Column) -> DataFrame:
    """Forecast table rows with their rendered key."""
    return forecast.select(
        F.lit(level).alias("level"),
        render_key(LEVEL_KEYS[level]).alias("key_str"),
        "slice_gap",
        "forecast_value",
        updated_at.cast("long").alias("updated_at"),
    )


def forecast_view(log: DataFrame) -> DataFrame:
    return latest_rows(log, ["level", "key_str", "slice_gap"], ["updated_at"])


def quality_view(log: DataFrame) -> DataFrame:
    return latest_rows(log, ["slice_gap", "version"], ["updated_at"])


def compact(spark: SparkSession, log_path: str, table_path: str) -> None:
    """Write the log's current device rows as a partitioned table."""
    write_slices(device_view(spark.read.parquet(log_path)), table_path)


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append to a database table in batches; the driver class comes with the cluster."""
    rows.write.option("batchsize", JDBC_BATCH).jdbc(url, table, mode="append", properties=properties)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties)
