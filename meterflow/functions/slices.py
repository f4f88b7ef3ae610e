"""Calendar, slice, key and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
MINUTE_MS = 60_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(left: Column | str, right: Column | int) -> Column:
    """Integer division that stays in integer arithmetic."""
    return F.call_function("div", _col(left), F.lit(right) if isinstance(right, int) else right)


def seconds_to_millis(seconds: Column | str) -> Column:
    return _col(seconds).cast("long") * F.lit(1000).cast("long")


def utc_date(event_ms: Column | str) -> Column:
    """UTC calendar day, independent of the session time zone."""
    return F.date_from_unix_date(int_div(event_ms, DAY_MS).cast("int"))


def slice_index(event_ms: Column | str, gap_minutes: int | Column) -> Column:
    """Slice number within the UTC day."""
    gap = F.lit(gap_minutes) if isinstance(gap_minutes, int) else gap_minutes
    return int_div(_col(event_ms) % DAY_MS, gap.cast("long") * MINUTE_MS).cast("int")


def year_of(day: Column | str) -> Column:
    return F.date_format(_col(day), "yyyy")


def month_of(day: Column | str) -> Column:
    return F.date_format(_col(day), "MM")


def day_of(day: Column | str) -> Column:
    return F.date_format(_col(day), "dd")


def date_text(day: Column | str) -> Column:
    return F.concat_ws("/", year_of(day), month_of(day), day_of(day))


def pad2(number: Column | str) -> Column:
    """Left zero pad, keeping the last two digits of longer numbers."""
    return F.right(F.concat(F.lit("0"), _col(number).cast("string")), F.lit(2))


def clock_text(minutes: Column) -> Column:
    return F.concat(pad2(int_div(minutes, 60)), F.lit(":"), pad2(minutes % 60))


def slice_label(day: Column | str, gap: Column | str, index: Column | str) -> Column:
    """``yyyy/MM/dd HH:MM->HH:MM``."""
    start = _col(index) * _col(gap)
    end = (_col(index) + 1) * _col(gap)
    return F.concat(date_text(day), F.lit(" "), clock_text(start), F.lit("->"), clock_text(end))


def gateway_of(house_id: Column | str, houses_per_gateway: int = 5) -> Column:
    """Each gateway serves a block of consecutive houses."""
    return F.concat(F.lit("gw-0"), (int_div(house_id, houses_per_gateway) + 1).cast("string"))


def safe_avg(total: Column | str = "value_sum", count: Column | str = "value_count") -> Column:
    return F.when(_col(count) > 0, _col(total) / _col(count)).otherwise(F.lit(0.0))


def round2(value: Column | str) -> Column:
    """Two decimals, halves always upwards (also below zero)."""
    return F.floor(_col(value) * 100 + 0.5) / 100


def exact_sum(value: Column | str, digits: int = 6) -> Column:
    """A sum that does not depend on the order of its rows: what adding up has blurred is far behind ``digits`` decimals."""
    return F.round(F.sum(_col(value)), digits)


def render_key(keys: list[str], day: str | None = "read_date", index: str | None = "slice_index") -> Column:
    """Colon-joined text key, needed only where a sink stores keys as text."""
    parts = [F.col(k).cast("string") for k in keys]
    if day:
        parts += [year_of(day), month_of(day), day_of(day)]
    if index:
        parts.append(F.col(index).cast("string"))
    return F.concat_ws(":", *parts)


def parse_device_key(key: Column | str) -> list[Column]:
    """Inverse of :func:`render_key` for a device slice."""
    parts = F.split(_col(key), ":")
    return [
        parts[0].cast("int").alias("house_id"),
        parts[1].cast("int").alias("household_id"),
        parts[2].cast("int").alias("plug_id"),
        F.to_date(F.concat_ws("-", parts[3], parts[4], parts[5])).alias("read_date"),
        parts[6].cast("int").alias("slice_index"),
    ]


def entity_prefix(key: Column | str) -> Column:
    """Text key without its last segment."""
    return F.regexp_replace(_col(key), ":[^:]*$", "")


def epoch_seconds(event_ms: Column | str) -> Column:
    return _col(event_ms) / F.lit(1000.0)
