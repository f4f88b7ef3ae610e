"""Gateway envelopes: cumulative partial aggregates of one gateway, window size and flush."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.functions.slices import day_of, gateway_of, month_of, year_of
from meterflow.schemas import DIRECT_WINDOWS, ENVELOPE
from meterflow.session import ship_package


#: Characters or bytes that a Python worker makes before it hands them on.
OUT_SIZE = 4 << 20


def _in_slices(batches: Iterator[pa.Array], convert: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """Converts value by value and hands on what has been made, so that no whole batch of unpacked bodies is held, however long each is."""
    for batch in batches:
        made, size = [], 0
        for value in batch:
            made.append(convert(value.as_py()))
            size += len(made[-1] or "")
            if size >= OUT_SIZE:
                yield pa.array(made, kind)
                made, size = [], 0
        yield pa.array(made, kind)


def _unpacked(data: bytes | None) -> str | None:
    try:
        return None if data is None else gzip.decompress(data).decode("utf-8")
    except (OSError, EOFError, UnicodeDecodeError, zlib.error):
        return None


def _packed(text: str | None) -> bytes | None:
    return None if text is None else gzip.compress(text.encode("utf-8"))


@F.arrow_udf(T.StringType())
def gunzip_text(payloads: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Undecodable payloads become null."""
    return _in_slices(payloads, _unpacked, pa.string())


@F.arrow_udf(T.BinaryType())
def gzip_text(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Message bodies for transports that carry compressed payloads."""
    return _in_slices(texts, _packed, pa.binary())


def encode_payloads(envelopes: DataFrame) -> DataFrame:
    ship_package(envelopes.sparkSession)
    return envelopes.select("gatewayId", gzip_text(F.to_json(F.struct(*ENVELOPE.fieldNames()))).alias("payload"))


def parse_envelopes(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to envelopes; blank and unreadable ones are skipped."""
    parsed = texts.where(F.trim(F.col(column)) != "").select(F.from_json(column, ENVELOPE).alias("e"))
    return parsed.select("e.*").where(F.col("windowSizeMin").isNotNull() & F.col("deviceRecords").isNotNull())


def decode_payloads(messages: DataFrame, column: str = "payload") -> DataFrame:
    """Envelopes out of compressed message bodies."""
    ship_package(messages.sparkSession)
    return parse_envelopes(messages.select(gunzip_text(column).alias("value")))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Plain or ``.gz`` JSON lines: written batches and queued outbox files alike."""
    return parse_envelopes(spark.read.text(path))


def known_windows_only(envelopes: DataFrame, windows: list[int] | None = None) -> DataFrame:
    return envelopes.where(F.col("windowSizeMin").isin(windows or DIRECT_WINDOWS) & (F.size("deviceRecords") > 0))


def batch_id() -> Column:
    """Unique per envelope; foreign envelopes have no ``part``."""
    return F.concat_ws("-", F.col("gatewayId"), F.col("windowSizeMin"), F.col("flushTimestamp"), F.col("part"))


def explode_envelopes(envelopes: DataFrame) -> DataFrame:
    """Envelopes to flush-log rows."""
    rows = envelopes.select(
        batch_id().alias("batch_id"),
        F.col("flushTimestamp").alias("flush_ts"),
        F.col("windowSizeMin").alias("slice_gap"),
        F.explode("deviceRecords").alias("r"),
    )
    return rows.select(
        F.col("r.houseId").alias("house_id"),
        F.col("r.householdId").alias("household_id"),
        F.col("r.plugId").alias("plug_id"),
        F.to_date(F.concat_ws("-", "r.year", "r.month", "r.day")).alias("read_date"),
        "slice_gap",
        F.col("r.sliceIndex").alias("slice_index"),
        "batch_id",
        "flush_ts",
        F.col("r.count").cast("long").alias("value_count"),
        F.col("r.sum").alias("value_sum"),
        F.col("r.eventTsMs").alias("event_ts"),
    )


def build_envelopes(flush_log: DataFrame) -> DataFrame:
    """Flush-log rows to envelopes.

    A gateway's flush has one envelope per house, whatever its size. The house is the envelope's ``part`` and part
    of its batch identifier, so the identifier stays unique.
    """
    record = F.struct(
        F.col("house_id").alias("houseId"),
        F.col("household_id").alias("householdId"),
        F.col("plug_id").alias("plugId"),
        year_of("read_date").alias("year"),
        month_of("read_date").alias("month"),
        day_of("read_date").alias("day"),
        F.col("slice_index").alias("sliceIndex"),
        F.col("value_count").cast("double").alias("count"),
        F.col("value_sum").alias("sum"),
        F.col("event_ts").alias("eventTsMs"),
    )
    flush = ["gatewayId", "flushTimestamp", "windowSizeMin", "part"]
    keyed = flush_log.select(
        gateway_of("house_id").alias("gatewayId"),
        F.col("flush_ts").alias("flushTimestamp"),
        F.col("slice_gap").alias("windowSizeMin"),
        F.col("house_id").alias("part"),
        record.alias("_record"),
    )
    return keyed.groupBy(*flush).agg(F.sort_array(F.collect_list("_record")).alias("deviceRecords"))
