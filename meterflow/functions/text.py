"""Display text, sizes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterflow.functions.slices import _col

# Size suffixes and their bytes; an unknown suffix counts as one.
SIZE_UNITS = {
    "B": 1.0,
    "KB": 1e3,
    "KIB": 1024.0,
    "MB": 1e6,
    "MIB": 1024.0**2,
    "GB": 1e9,
    "GIB": 1024.0**3,
    "TB": 1e12,
    "TIB": 1024.0**4,
}
SIZE_PATTERN = r"^\s*([\d.]+)\s*([A-Za-z]+)"


def parse_size(text: Column | str) -> Column:
    """``12.3MB`` or ``4.5kiB`` to bytes; null when it is not a size."""
    number = F.regexp_extract(_col(text), SIZE_PATTERN, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(_col(text), SIZE_PATTERN, 2))
    table = F.create_map(*[F.lit(x) for pair in SIZE_UNITS.items() for x in pair])
    return number * F.coalesce(F.try_element_at(table, unit), F.lit(1.0))


def fixed(value: Column, digits: int) -> Column:
    """Fixed number of decimals, rounding the exact binary value."""
    return F.translate(F.format_number(value, digits), ",", "")


def rounded(value: Column, digits: int) -> Column:
    """The nearest number with that many decimals, judged on the exact binary value.

    Nine digits come first: a mean half-way between two results must not depend on the order of addition.
    """
    return fixed(F.round(value, 9), digits).cast("double")


def fixed2(value: Column) -> Column:
    """Two decimals; an exact half (only multiples of 1/8 can be one) goes away from zero."""
    eighths = value * 8
    return fixed(F.when(eighths == F.round(eighths), value + F.signum(value) * 1e-4).otherwise(value), 2)


def change_text(kind: Column | str, value: Column | str, low: Column | str, usual: Column | str, high: Column | str) -> Column:
    """Signed difference to the limit that applies, in watts and per cent."""

    def against(sign: str, limit: Column) -> Column:
        difference = _col(value) - limit
        return F.concat(F.lit(sign), fixed2(difference), F.lit("W ("), fixed2(difference * 100 / limit), F.lit("%)"))

    return (
        F.when(_col(kind) == -1, against("-", _col(low)))
        .when(_col(kind) == 0, against("+", _col(usual)))
        .when(_col(kind) == 1, against("+", _col(high)))
    )


def time_ago(event_ms: Column | str, as_of_ms: Column | int) -> Column:
    """Age in the largest whole unit, as of a given time."""
    as_of = F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms
    age = as_of - _col(event_ms)

    def whole(unit_ms: int, name: str) -> Column:
        return F.concat(F.floor(age / unit_ms).cast("string"), F.lit(f" {name}(s) ago"))

    # Unit limits and wording.
    return (
        F.when(age < 2_000, "Just now")
        .when(age < 60_000, whole(1_000, "second"))
        .when(age < 3_600_000, whole(60_000, "minute"))
        .when(age < 86_400_000, whole(3_600_000, "hour"))
        .otherwise(whole(86_400_000, "day"))
    )


def percent_change(base: Column | str, other: Column | str) -> Column:
    """Null when the base is zero or either side is missing."""
    return F.when(_col(base) != 0, (_col(other) - _col(base)) / _col(base) * 100)


def arrow_pct(base: Column | str, other: Column | str) -> Column:
    """Change with an arrow: one decimal, two above 99 per cent, a dash when undefined."""
    change = percent_change(base, other)
    size = F.abs(change)
    number = F.when(size > 99, fixed(size, 2)).otherwise(fixed(size, 1))
    arrow = F.when(change < 0, "↓ ").otherwise("↑ ")
    return F.when(change.isNull(), F.lit("—")).otherwise(F.concat(arrow, number, F.lit("%")))


def format_number(value: Column | str) -> Column:
    """NA, thousands without decimals, whole numbers, else up to three decimals."""
    v = _col(value)
    trimmed = F.regexp_replace(fixed(v, 3), r"\.?0+$", "")
    return (
        F.when(v.isNull(), F.lit("NA"))
        .when(F.abs(v) >= 1000, F.format_number(v, 0))
        .when(v == F.floor(v), F.format_string("%d", v.cast("long")))
        .otherwise(trimmed)
    )
