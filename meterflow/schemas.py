"""Declared schemas: nothing in this package infers types from data."""

from __future__ import annotations

from pyspark.sql import types as T

DEVICE = ["house_id", "household_id", "plug_id"]
HOUSEHOLD = ["house_id", "household_id"]
HOUSE = ["house_id"]
LEVEL_KEYS = {"device": DEVICE, "household": HOUSEHOLD, "house": HOUSE}
SLICE = ["read_date", "slice_gap", "slice_index"]

# Window sizes in minutes kept at the edge, and those derived later from the 30-minute ones.
DIRECT_WINDOWS = [1, 5, 10, 15, 30]
DERIVED_WINDOWS = [60, 120]

READING = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("property", T.IntegerType()),
        T.StructField("plug_id", T.IntegerType()),
        T.StructField("household_id", T.IntegerType()),
        T.StructField("house_id", T.IntegerType()),
    ]
)

# Names below are the wire format of the gateway envelope.
ENVELOPE_RECORD = T.StructType(
    [
        T.StructField("houseId", T.IntegerType()),
        T.StructField("householdId", T.IntegerType()),
        T.StructField("plugId", T.IntegerType()),
        T.StructField("year", T.StringType()),
        T.StructField("month", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("sliceIndex", T.IntegerType()),
        T.StructField("count", T.DoubleType()),
        T.StructField("sum", T.DoubleType()),
        T.StructField("eventTsMs", T.LongType()),
    ]
)
ENVELOPE = T.StructType(
    [
        T.StructField("gatewayId", T.StringType()),
        T.StructField("flushTimestamp", T.LongType()),
        T.StructField("windowSizeMin", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("deviceRecords", T.ArrayType(ENVELOPE_RECORD)),
    ]
)

_SLICE_FIELDS = [
    T.StructField("read_date", T.DateType()),
    T.StructField("slice_gap", T.IntegerType()),
    T.StructField("slice_index", T.IntegerType()),
    T.StructField("value_count", T.LongType()),
    T.StructField("value_sum", T.DoubleType()),
]
_IDS = {name: T.StructField(name, T.IntegerType()) for name in DEVICE}


def slice_schema(level: str) -> T.StructType:
    """Stored table of one level: ids, slice, accumulators and write times."""
    fields = [_IDS[name] for name in LEVEL_KEYS[level]] + _SLICE_FIELDS
    if level == "device":
        fields = fields + [
            T.StructField("event_ts", T.LongType()),
            T.StructField("first_written_at", T.LongType()),
        ]
    return T.StructType(fields + [T.StructField("updated_at", T.LongType())])


FORECAST = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("key_str", T.StringType()),
        T.StructField("slice_gap", T.IntegerType()),
        T.StructField("forecast_value", T.DoubleType()),
        T.StructField("updated_at", T.LongType()),
    ]
)
QUALITY = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("slice_gap", T.IntegerType()),
        T.StructField("count", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("variance", T.DoubleType()),
        T.StructField("standard_deviation", T.DoubleType()),
        T.StructField("mse", T.DoubleType()),
    ]
)
NOTIFICATION = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("house_id", T.IntegerType()),
        T.StructField("household_id", T.IntegerType()),
        T.StructField("plug_id", T.IntegerType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("avg", T.DoubleType()),
        T.StructField("read_date", T.DateType()),
        T.StructField("slice_gap", T.IntegerType()),
        T.StructField("slice_index", T.IntegerType()),
        T.StructField("reg_ms", T.LongType()),
    ]
)
