"""The query API: series, forecasts, metadata, forecast quality and notification pages."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions.slices import date_text, day_of, month_of, safe_avg, slice_label, year_of
from meterflow.operators.forecast import profile_forecast
from meterflow.schemas import LEVEL_KEYS, SLICE

ANY = "*"


@dataclass(frozen=True)
class SeriesQuery:
    """Optional filters of a series request; month and day may come without leading zeros."""

    house_id: int | str | None = None
    household_id: int | str | None = None
    device_id: int | str | None = None
    year: int | str | None = None
    month: int | str | None = None
    day: int | str | None = None
    slice_gap: int | None = None
    slice_index: int | None = None

    def level(self) -> str:
        """The table that answers: household missing or ``*`` means house, device likewise means household."""
        if self.household_id in (None, "", ANY):
            return "house"
        return "household" if self.device_id in (None, "", ANY) else "device"

    def condition(self, level: str, with_day: bool = True) -> Column:
        ids = dict(zip(["house_id", "household_id", "plug_id"], [self.house_id, self.household_id, self.device_id]))
        terms = [F.col(k) == int(v) for k, v in ids.items() if k in LEVEL_KEYS[level] and v not in (None, "", ANY)]
        if None not in (self.year, self.month, self.day) and with_day:
            # A full date reaches the partition column as one literal.
            text = f"{int(self.year):04d}-{int(self.month):02d}-{int(self.day):02d}"
            terms.append(F.col("read_date") == F.lit(text).cast("date"))
        else:
            parts: list[tuple[Any, Column]] = [(self.year, F.year("read_date")), (self.month, F.month("read_date"))]
            if with_day:
                parts.append((self.day, F.dayofmonth("read_date")))
            terms += [column == int(v) for v, column in parts if v is not None]
        terms += [F.col(k) == int(v) for k, v in [("slice_gap", self.slice_gap), ("slice_index", self.slice_index)] if v is not None]
        out = F.lit(True)
        for term in terms:
            out = out & term
        return out


def _shape(rows: DataFrame, level: str, value: str) -> DataFrame:
    ids = [F.col(k).alias("device_id" if k == "plug_id" else k) for k in LEVEL_KEYS[level]]
    return rows.select(
        *ids,
        year_of("read_date").alias("year"),
        month_of("read_date").alias("month"),
        day_of("read_date").alias("day"),
        "slice_index",
        "slice_gap",
        F.col(value).alias("avg"),
        slice_label("read_date", "slice_gap", "slice_index").alias("label"),
    )


def query_series(tables: dict[str, DataFrame], query: SeriesQuery) -> DataFrame:
    """Averages of the requested slices, one row per entity and label."""
    level = query.level()
    rows = tables[level].where(query.condition(level)).withColumn("avg", safe_avg())
    return _shape(rows, level, "avg")


def query_forecast(tables: dict[str, DataFrame], query: SeriesQuery, version: str | None = None) -> DataFrame:
    """Profile value of each requested slice; the profile spans all days. ``version`` is accepted and ignored."""
    level = query.level()
    table = tables[level]
    actual, history = table.where(query.condition(level)), table.where(query.condition(level, with_day=False))
    return _shape(profile_forecast(actual, level, history), level, "forecast_avg")


def _week(week: int) -> Column:
    return F.dayofmonth("read_date").between(1 + 7 * week, 7 + 7 * week)


def query_week(tables: dict[str, DataFrame], query: SeriesQuery, week: int) -> DataFrame:
    """Days ``1+7w`` to ``7+7w`` of the requested month."""
    level = query.level()
    rows = tables[level].where(query.condition(level, with_day=False) & _week(week))
    return _shape(rows.withColumn("avg", safe_avg()), level, "avg")


def forecast_week(tables: dict[str, DataFrame], query: SeriesQuery, week: int) -> DataFrame:
    level = query.level()
    history = tables[level].where(query.condition(level, with_day=False))
    return _shape(profile_forecast(history.where(_week(week)), level, history), level, "forecast_avg")


def meta_slice_gaps(house_table: DataFrame) -> DataFrame:
    return house_table.select("slice_gap").distinct().orderBy("slice_gap")


def meta_dates(table: DataFrame, level: str) -> DataFrame:
    """Distinct entities and dates, in date order."""
    rows = table.select(*LEVEL_KEYS[level], "read_date").distinct()
    return rows.select(
        *LEVEL_KEYS[level],
        year_of("read_date").alias("year"),
        month_of("read_date").alias("month"),
        day_of("read_date").alias("day"),
        date_text("read_date").alias("text"),
    ).orderBy("text", *LEVEL_KEYS[level])


def meta_topology(table: DataFrame, level: str) -> DataFrame:
    """One row per entity with its list of dates, which the calendar bounds."""
    keys = LEVEL_KEYS[level]
    dates = F.array_sort(F.collect_set("read_date"))
    entry = F.transform(
        dates,
        lambda d: F.struct(
            year_of(d).alias("year"), month_of(d).alias("month"), day_of(d).alias("day"), date_text(d).alias("text")
        ),
    )
    return table.groupBy(*keys).agg(entry.alias("dates"))


def meta(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Window sizes and the dates of every entity at each level."""
    out = {f"{level}_data_topo": meta_topology(table, level) for level, table in tables.items()}
    out["slice_gap"] = meta_slice_gaps(tables["house"])
    return out


def forecast_metadata(quality: DataFrame, version: str, slice_gap: int) -> DataFrame:
    """Stored quality figures; both arguments are required."""
    if not version or not slice_gap:
        raise ValueError("version and slice_gap are required")
    return quality.where((F.col("version") == version) & (F.col("slice_gap") == slice_gap))


def notifications_page(
    notifications: DataFrame,
    level: str,
    house_id: int | None = None,
    household_id: int | None = None,
    device_id: int | None = None,
    offset: int = 0,
    limit: int = 10,
) -> DataFrame:
    """Newest notifications first. A narrower id only counts together with all wider ones.

    Spark keeps no more than ``offset + limit`` rows per task, so the table is never sorted as a whole.
    """
    rows = notifications.where(F.col("level") == level)
    for key, wanted in zip(LEVEL_KEYS[level], [house_id, household_id, device_id]):
        if wanted is None:
            break
        rows = rows.where(F.col(key) == wanted)
    order = [F.desc("reg_ms"), *LEVEL_KEYS[level], *SLICE]
    return rows.orderBy(*order).offset(offset).limit(limit)
