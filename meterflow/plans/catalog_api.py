"""The query API over the level tables built from readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.operators import windows as w
from meterflow.plans import api, sql
from meterflow.plans.catalog_alerts import NOTIFICATIONS_SQL, notifications
from meterflow.plans.catalog_slices import DENSE, QUALITY_SQL, forecast_quality_rows, loads
from meterflow.plans.registry import query
from meterflow.schemas import LEVEL_KEYS
from meterflow.session import scratch_path
from meterflow.sinks import tables as stored

_GAPS = [30, 120]
_TABLES = f"{DENSE}, {sql.slices(_GAPS, 'device')}, {sql.rollup('household', 'household', 'device')}, {sql.rollup('house', 'house', 'device')}"
_PARTS = """substr(read_date, 1, 4) AS year, substr(read_date, 6, 2) AS month, substr(read_date, 9, 2) AS day,
  slice_index, slice_gap"""


#: Where the tables of a data set are stored, by application: requests read them, only the first one builds them.
_STORED: dict[tuple[str, str], str] = {}


def _root(spark, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = scratch_path(spark, "levels")
        stored.write_levels(w.multi_window(loads(spark, sf_dir, "dense"), _GAPS), root)
        stored.write_notifications(notifications(spark, sf_dir), f"{root}/notification")
        _STORED[key] = root
    return _STORED[key]


def tables(spark, sf_dir) -> dict[str, DataFrame]:
    return stored.read_levels(spark, _root(spark, sf_dir))


def _ids(level: str) -> str:
    return ", ".join("plug_id AS device_id" if k == "plug_id" else k for k in LEVEL_KEYS[level])


def _series(level: str, condition: str) -> str:
    return f"SELECT {_ids(level)}, {_PARTS}, {sql.SAFE_AVG} AS avg, {sql.label()} AS label FROM {level} WHERE {condition}"


def _profile(level: str, condition: str, history: str) -> str:
    keys = ", ".join([*LEVEL_KEYS[level], "slice_gap", "slice_index"])
    return f"""SELECT {_ids(level)}, {_PARTS}, f AS avg, {sql.label()} AS label
      FROM (SELECT * FROM {level} WHERE {condition}) JOIN (
        SELECT {keys}, avg({sql.SAFE_AVG}) AS f FROM {level} WHERE {history} GROUP BY ALL) USING ({keys})"""


@query("query_series", f"WITH {_TABLES} {_series('house', 'slice_gap = 30')}", rounded="avg")
def _(spark, sf_dir):
    return api.query_series(tables(spark, sf_dir), api.SeriesQuery(slice_gap=30))


_LEVEL_QUERIES = {
    "house": api.SeriesQuery(house_id=1, year=2024, month=1, day=5),
    "household": api.SeriesQuery(house_id=1, household_id=1, device_id="*", month="01"),
    "device": api.SeriesQuery(house_id=1, household_id=1, device_id=2, slice_gap=30, slice_index=20),
}
_LEVEL_CONDITIONS = {
    "house": "house_id = 1 AND read_date = '2024-01-05'",
    "household": "house_id = 1 AND household_id = 1 AND substr(read_date, 6, 2) = '01'",
    "device": "house_id = 1 AND household_id = 1 AND plug_id = 2 AND slice_gap = 30 AND slice_index = 20",
}


@query(
    "level_dispatch",
    f"WITH {_TABLES} "
    + " UNION ALL ".join(
        f"SELECT '{level}' AS level, house_id, year, month, day, slice_index, slice_gap, avg, label FROM ({_series(level, c)})"
        for level, c in _LEVEL_CONDITIONS.items()
    ),
    rounded="avg",
)
def _(spark, sf_dir):
    levels, out = tables(spark, sf_dir), None
    columns = ["level", "house_id", "year", "month", "day", "slice_index", "slice_gap", "avg", "label"]
    for wanted in _LEVEL_QUERIES.values():
        rows = api.query_series(levels, wanted).withColumn("level", F.lit(wanted.level())).select(*columns)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "filter_wildcards",
    f"WITH {_TABLES} {_profile('household', 'household_id = 1 AND day(CAST(read_date AS DATE)) = 7', 'household_id = 1')}",
    rounded="avg",
)
def _(spark, sf_dir):
    wanted = api.SeriesQuery(house_id="*", household_id=1, device_id="*", day="07")
    return api.query_forecast(tables(spark, sf_dir), wanted, version="v0")


@query("query_forecast", f"WITH {_TABLES} {_profile('house', 'slice_gap = 120', 'slice_gap = 120')}", rounded="avg")
def _(spark, sf_dir):
    return api.query_forecast(tables(spark, sf_dir), api.SeriesQuery(slice_gap=120))


_WEEK = "year(CAST(read_date AS DATE)) = 2024 AND month(CAST(read_date AS DATE)) = 1"
_DAYS = f"{_WEEK} AND day(CAST(read_date AS DATE)) BETWEEN 8 AND 14"


@query("query_week", f"WITH {_TABLES} {_series('house', _DAYS)}", rounded="avg")
def _(spark, sf_dir):
    return api.query_week(tables(spark, sf_dir), api.SeriesQuery(year=2024, month=1), 1)


@query("forecast_week", f"WITH {_TABLES} {_profile('house', _DAYS, _WEEK)}", rounded="avg")
def _(spark, sf_dir):
    return api.forecast_week(tables(spark, sf_dir), api.SeriesQuery(year=2024, month=1), 1)


@query("meta_slice_gaps", f"WITH {_TABLES} SELECT DISTINCT slice_gap FROM house ORDER BY 1")
def _(spark, sf_dir):
    return api.meta_slice_gaps(tables(spark, sf_dir)["house"])


def _dates(level: str) -> str:
    ids = {"device": "household_id, plug_id", "household": "household_id, NULL", "house": "NULL, NULL"}[level]
    a, b = ids.split(", ")
    return f"""SELECT DISTINCT '{level}' AS level, house_id, CAST({a} AS INT) AS household_id, CAST({b} AS INT) AS plug_id,
      substr(read_date, 1, 4) AS year, substr(read_date, 6, 2) AS month, substr(read_date, 9, 2) AS day,
      replace(read_date, '-', '/') AS text FROM {level}"""


_META = f"WITH {_TABLES} " + " UNION ALL ".join(_dates(level) for level in LEVEL_KEYS)
_META_COLUMNS = ["level", "house_id", "household_id", "plug_id", "year", "month", "day", "text"]


@query("meta_topology", _META)
def _(spark, sf_dir):
    out = None
    for level, table in tables(spark, sf_dir).items():
        nested = api.meta_topology(table, level).select(*LEVEL_KEYS[level], F.explode("dates").alias("d"))
        rows = nested.select(F.lit(level).alias("level"), *LEVEL_KEYS[level], "d.*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select(*_META_COLUMNS)


@query("meta_sorted", f"WITH {_TABLES}, m AS ({_dates('device')}) SELECT * EXCLUDE (level) FROM m ORDER BY text")
def _(spark, sf_dir):
    return api.meta_dates(tables(spark, sf_dir)["device"], "device")


@query(
    "forecast_metadata",
    f"SELECT * FROM ({QUALITY_SQL}) WHERE version = 'v0' AND slice_gap = 30",
    rounded="mean variance standard_deviation mse",
)
def _(spark, sf_dir):
    return api.forecast_metadata(forecast_quality_rows(spark, sf_dir), "v0", 30)


_PAGE = ["level", "house_id", "household_id", "plug_id", "value", "max", "avg", "read_date", "slice_index", "reg_ms"]
_ORDER = "reg_ms DESC, house_id, household_id, plug_id, read_date, slice_gap, slice_index"


@query(
    "notifications_page",
    f"""WITH {NOTIFICATIONS_SQL}
    SELECT {', '.join(_PAGE)} FROM (SELECT * FROM notes WHERE level = 'device' ORDER BY {_ORDER} LIMIT 10 OFFSET 20)
    UNION ALL
    SELECT {', '.join(_PAGE)} FROM (SELECT * FROM notes WHERE level = 'house' AND house_id = 3 ORDER BY {_ORDER} LIMIT 10)""",
)
def _(spark, sf_dir):
    notes = stored.read_notifications(spark, f"{_root(spark, sf_dir)}/notification")
    device = api.notifications_page(notes, "device", offset=20, limit=10)
    house = api.notifications_page(notes, "house", house_id=3)
    return device.select(*_PAGE).unionByName(house.select(*_PAGE))
