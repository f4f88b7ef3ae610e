"""Filters, keys, slices, rollups, merges and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import slices as fs
from meterflow.operators import forecast as fc
from meterflow.operators import windows as w
from meterflow.plans import sql
from meterflow.plans.registry import query
from meterflow.schemas import DERIVED_WINDOWS, DEVICE, DIRECT_WINDOWS, LEVEL_KEYS, SLICE
from meterflow.sinks.tables import device_view, forecast_rows
from meterflow.sources.driver_tables import driver_readings
from meterflow.sources.readings import assign_gateway, filter_load, filter_shard, ingest_counters

WIDE, DENSE = sql.readings("wide"), sql.readings("dense")
SHARD = [0, 1, 2, 3, 4]


def loads(spark, sf_dir, layout="wide") -> DataFrame:
    return filter_load(driver_readings(spark, sf_dir, layout))


def device_slices(spark, sf_dir, gap: int, layout="wide") -> DataFrame:
    return w.window_slices(loads(spark, sf_dir, layout), gap)


# --- rows --------------------------------------------------------------------------------------------------------

_READING = "event_id, event_ms, value, property, plug_id, household_id, house_id"


@query("filter_load", f"WITH {WIDE} SELECT {_READING} FROM loads")
def _(spark, sf_dir):
    return filter_load(driver_readings(spark, sf_dir))


@query("filter_shard", f"WITH {WIDE} SELECT {_READING} FROM loads WHERE house_id IN (0, 1, 2, 3, 4)")
def _(spark, sf_dir):
    return filter_shard(loads(spark, sf_dir), SHARD)


@query(
    "ingest_counters",
    f"""WITH {WIDE} SELECT {sql.gateway()} AS gateway_id, count(*) AS received,
    count(*) FILTER (WHERE property = 1 AND house_id < 5) AS emitted,
    count(*) FILTER (WHERE property = 1 AND house_id >= 5) AS filtered FROM readings GROUP BY 1""",
)
def _(spark, sf_dir):
    return ingest_counters(driver_readings(spark, sf_dir), SHARD)


@query("assign_gateway", f"WITH {WIDE} SELECT event_id, house_id, {sql.gateway()} AS gateway_id FROM readings")
def _(spark, sf_dir):
    return assign_gateway(driver_readings(spark, sf_dir)).select("event_id", "house_id", "gateway_id")


@query(
    "calendar_split",
    "SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day FROM events",
)
def _(spark, sf_dir):
    day = fs.utc_date("event_ms")
    return driver_readings(spark, sf_dir).select(
        "event_id", fs.year_of(day).alias("year"), fs.month_of(day).alias("month"), fs.day_of(day).alias("day")
    )


@query(
    "slice_index",
    f"""WITH {WIDE} SELECT event_id, slice_gap, CAST((event_ms % 86400000) // (slice_gap * 60000) AS INT) AS slice_index
    FROM (SELECT event_id, event_ms, CAST(unnest({DIRECT_WINDOWS + DERIVED_WINDOWS}) AS INT) AS slice_gap FROM readings)""",
)
def _(spark, sf_dir):
    gaps = F.explode(F.array(*[F.lit(g) for g in DIRECT_WINDOWS + DERIVED_WINDOWS]))
    rows = driver_readings(spark, sf_dir).select("event_id", "event_ms", gaps.alias("slice_gap"))
    return rows.select("event_id", "slice_gap", fs.slice_index("event_ms", F.col("slice_gap")).alias("slice_index"))


@query(
    "seconds_to_millis",
    f"WITH {WIDE} SELECT event_id, (event_ms // 1000) * 1000 AS produced_ms FROM readings",
)
def _(spark, sf_dir):
    seconds = fs.int_div("event_ms", 1000)
    return driver_readings(spark, sf_dir).select("event_id", fs.seconds_to_millis(seconds).alias("produced_ms"))


_KEY = f"""house_id || ':' || household_id || ':' || plug_id || ':' || replace(read_date, '-', ':') || ':' || slice_index"""


@query("render_key", f"WITH {WIDE}, {sql.slices([30])} SELECT {_KEY} AS key_str, value_count FROM slices")
def _(spark, sf_dir):
    return device_slices(spark, sf_dir, 30).select(fs.render_key(DEVICE).alias("key_str"), "value_count")


@query(
    "parse_key",
    f"WITH {WIDE}, {sql.slices([30])} SELECT {sql.IDS}, read_date, slice_index, value_count FROM slices",
)
def _(spark, sf_dir):
    keyed = device_slices(spark, sf_dir, 30).select(fs.render_key(DEVICE).alias("key_str"), "value_count")
    return keyed.select(*fs.parse_device_key("key_str"), "value_count")


@query(
    "entity_prefix",
    f"""WITH {WIDE}, {sql.slices([30])}
    SELECT regexp_replace({_KEY}, ':[^:]*$', '') AS entity, count(*) AS slices FROM slices GROUP BY 1""",
)
def _(spark, sf_dir):
    keyed = device_slices(spark, sf_dir, 30).select(fs.entity_prefix(fs.render_key(DEVICE)).alias("entity"))
    return keyed.groupBy("entity").agg(F.count("*").alias("slices"))


@query(
    "safe_avg",
    f"WITH {WIDE}, {sql.slices([120])} SELECT {sql.IDS}, read_date, slice_index, {sql.SAFE_AVG} AS avg FROM slices",
    rounded="avg",
)
def _(spark, sf_dir):
    rows = device_slices(spark, sf_dir, 120)
    return rows.select(*DEVICE, "read_date", "slice_index", fs.safe_avg().alias("avg"))


@query(
    "slice_label",
    f"WITH {WIDE}, {sql.slices([1, 30, 60, 120])} SELECT DISTINCT read_date, slice_gap, slice_index, {sql.label()} AS label FROM slices",
)
def _(spark, sf_dir):
    rows = w.multi_window(loads(spark, sf_dir), [1, 30, 60, 120]).select(*SLICE).distinct()
    return rows.withColumn("label", fs.slice_label("read_date", "slice_gap", "slice_index"))


@query("pad2", "SELECT p_partkey, p_size, right('0' || p_size, 2) AS padded, right('0' || p_partkey, 2) AS key_padded FROM part")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", "p_size", fs.pad2("p_size").alias("padded"), fs.pad2("p_partkey").alias("key_padded"))


@query("date_text", f"WITH {WIDE} SELECT event_id, replace({sql.day_text()}, '-', '/') AS date_text FROM readings")
def _(spark, sf_dir):
    rows = driver_readings(spark, sf_dir)
    return rows.select("event_id", fs.date_text(fs.utc_date("event_ms")).alias("date_text"))


@query(
    "round2",
    f"""SELECT o_orderkey, {sql.round2('o_totalprice / 7')} AS above, {sql.round2('-o_totalprice / 7')} AS below,
    {sql.round2('-o_totalprice / 8')} AS halves FROM orders""",
)
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        fs.round2(price / 7).alias("above"),
        fs.round2(-price / 7).alias("below"),
        fs.round2(-price / 8).alias("halves"),
    )


# --- slices ------------------------------------------------------------------------------------------------------

_DEVICE_ROW = f"{sql.IDS}, read_date, slice_gap, slice_index, value_count, value_sum, event_ts"


@query("window_slice_agg", f"WITH {WIDE}, {sql.slices([30])} SELECT {_DEVICE_ROW} FROM slices", rounded="value_sum")
def window_slice_agg(spark, sf_dir):
    return device_slices(spark, sf_dir, 30)


@query(
    "multi_window_fanout",
    f"WITH {WIDE}, {sql.slices(DIRECT_WINDOWS)} SELECT {_DEVICE_ROW} FROM slices",
    rounded="value_sum",
)
def _(spark, sf_dir):
    return w.multi_window(loads(spark, sf_dir))


@query(
    "derive_window",
    f"""WITH {WIDE}, {sql.slices(DERIVED_WINDOWS)}
    SELECT * REPLACE (CAST(0 AS BIGINT) AS event_ts) FROM (SELECT {_DEVICE_ROW} FROM slices)""",
    rounded="value_sum",
)
def _(spark, sf_dir):
    base = device_slices(spark, sf_dir, 30)
    return w.derive_window(base, 60).unionByName(w.derive_window(base, 120))


def _level_row(level: str) -> str:
    return f"{', '.join(LEVEL_KEYS[level])}, read_date, slice_gap, slice_index, value_count, value_sum"


@query(
    "rollup_household",
    f"WITH {DENSE}, {sql.slices([30, 120])}, {sql.rollup('household', 'hh')} SELECT {_level_row('household')} FROM hh",
    rounded="value_sum",
)
def _(spark, sf_dir):
    return w.rollup(w.multi_window(loads(spark, sf_dir, "dense"), [30, 120]), "household")


@query(
    "rollup_house",
    f"WITH {DENSE}, {sql.slices([30, 120])}, {sql.rollup('house', 'h')} SELECT {_level_row('house')} FROM h",
    rounded="value_sum",
)
def _(spark, sf_dir):
    return w.rollup(w.multi_window(loads(spark, sf_dir, "dense"), [30, 120]), "house")


@query(
    "house_avg_watt",
    f"""WITH {WIDE}, {sql.slices([5])}
    SELECT house_id, avg(value_sum / value_count) AS house_avg FROM slices WHERE value_count > 0 GROUP BY 1""",
    rounded="house_avg",
)
def _(spark, sf_dir):
    return w.house_avg_watt(device_slices(spark, sf_dir, 5))


_VIEW = f"WITH {DENSE}, {sql.flushes(120)}, {sql.device_view()}"


def dense_log(spark, sf_dir, gap: int = 120) -> DataFrame:
    return w.flush_log(loads(spark, sf_dir, "dense"), gap)


@query(
    "merge_latest",
    f"{_VIEW} SELECT {sql.IDS}, read_date, slice_gap, slice_index, value_count, value_sum FROM device",
    rounded="value_sum",
)
def _(spark, sf_dir):
    return w.merge_latest(dense_log(spark, sf_dir)).drop("event_ts", "first_written_at", "updated_at")


@query("merge_event_ts", f"{_VIEW} SELECT {sql.IDS}, read_date, slice_gap, slice_index, event_ts FROM device")
def _(spark, sf_dir):
    return w.merge_latest(dense_log(spark, sf_dir)).select(*DEVICE, *SLICE, "event_ts")


@query(
    "attach_event_ts",
    f"""{_VIEW}, {sql.slices([120])} SELECT {', '.join('s.' + k for k in DEVICE)}, s.read_date, s.slice_index, s.value_count,
    coalesce(d.event_ts, 0) AS event_ts FROM slices s LEFT JOIN device d
    USING (house_id, household_id, plug_id, read_date, slice_gap, slice_index)""",
)
def _(spark, sf_dir):
    # The freshest event time comes out of the same aggregation as the totals, so nothing is joined.
    view = device_view(dense_log(spark, sf_dir))
    return view.select(*DEVICE, "read_date", "slice_index", "value_count", "event_ts")


@query(
    "union_gateways",
    f"""WITH {WIDE}, {sql.slices([60])} SELECT {sql.gateway()} AS gateway_id, count(*) AS slices,
    CAST(sum(value_count) AS BIGINT) AS readings FROM slices GROUP BY 1""",
)
def _(spark, sf_dir):
    # Gateways own disjoint houses, so their outputs lie side by side in one table and need no merging.
    slices = w.window_slices(assign_gateway(loads(spark, sf_dir)), 60)
    return slices.groupBy(fs.gateway_of("house_id").alias("gateway_id")).agg(
        F.count("*").alias("slices"), F.sum("value_count").alias("readings")
    )


# --- forecasts ---------------------------------------------------------------------------------------------------


def _median_sql(level: str, source: str) -> str:
    keys = ", ".join(LEVEL_KEYS[level])
    key = " || ':' || ".join([*LEVEL_KEYS[level], "replace(read_date, '-', ':')", "slice_index"])
    return f"""SELECT '{level}' AS level, {key} AS key_str, slice_gap,
    {sql.round2('CASE WHEN med > 0 THEN (a + med) / 2 ELSE a END')} AS forecast_value FROM (
      SELECT *, median(a) OVER (PARTITION BY {keys}, read_date, slice_gap) AS med FROM (
        SELECT *, value_sum / value_count AS a FROM {source} WHERE value_count > 0))"""


_LEVELS = f"{sql.rollup('household', 'hh')}, {sql.rollup('house', 'h')}"


@query(
    "median_forecast",
    f"""WITH {DENSE}, {sql.slices([30, 15])}, {_LEVELS}
    {_median_sql('device', 'slices')} UNION ALL {_median_sql('household', 'hh')} UNION ALL {_median_sql('house', 'h')}""",
)
def _(spark, sf_dir):
    device = w.multi_window(loads(spark, sf_dir, "dense"), [15, 30])
    out = None
    for level in LEVEL_KEYS:
        rows = forecast_rows(fc.median_forecast(w.rollup(device, level), level), level, F.lit(0)).drop("updated_at")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "slice_profile",
    f"""WITH {DENSE}, {sql.slices([60])}
    SELECT {sql.IDS}, slice_gap, slice_index, avg({sql.SAFE_AVG}) AS profile_avg FROM slices
    GROUP BY {sql.IDS}, slice_gap, slice_index""",
    rounded="profile_avg",
)
def _(spark, sf_dir):
    return fc.slice_profile(device_slices(spark, sf_dir, 60, "dense"), "device")


@query(
    "profile_forecast",
    f"""WITH {DENSE}, {sql.slices([120])}, p AS (
      SELECT {sql.IDS}, slice_gap, slice_index, avg({sql.SAFE_AVG}) AS f FROM slices GROUP BY ALL)
    SELECT {', '.join('a.' + k for k in DEVICE)}, a.read_date, a.slice_gap, a.slice_index,
      {sql.SAFE_AVG} AS actual_avg, f AS forecast_avg
    FROM slices a JOIN p USING (house_id, household_id, plug_id, slice_gap, slice_index)""",
    rounded="actual_avg forecast_avg",
)
def _(spark, sf_dir):
    return fc.profile_forecast(device_slices(spark, sf_dir, 120, "dense"), "device")


_NAIVE = f"""WITH {DENSE}, {sql.slices([120])}, {sql.rollup('house', 'h')},
a AS (SELECT house_id, read_date, slice_gap, slice_index, {sql.SAFE_AVG} AS actual_avg FROM h),
f AS (SELECT house_id, strftime(CAST(read_date AS DATE) + 1, '%Y-%m-%d') AS read_date, slice_gap, slice_index,
      actual_avg AS forecast_avg FROM a)"""
_SERIES_KEYS = ["house_id", "read_date", "slice_gap", "slice_index"]


def house_series(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """House averages and, as a naive forecast, the same series one day later."""
    house = w.rollup(device_slices(spark, sf_dir, 120, "dense"), "house")
    actual = house.select(*_SERIES_KEYS, fs.safe_avg().alias("actual_avg"))
    forecast = actual.withColumn("read_date", F.date_add("read_date", 1)).withColumnRenamed("actual_avg", "forecast_avg")
    return actual, forecast


@query(
    "align_series",
    f"""{_NAIVE} SELECT house_id, read_date, slice_gap, slice_index, coalesce(actual_avg, 0) AS actual_avg,
    coalesce(forecast_avg, 0) AS forecast_avg FROM a FULL JOIN f USING (house_id, read_date, slice_gap, slice_index)""",
    rounded="actual_avg forecast_avg",
)
def _(spark, sf_dir):
    return fc.align_series(*house_series(spark, sf_dir), _SERIES_KEYS)


@query(
    "actual_vs_forecast",
    f"""{_NAIVE} SELECT house_id, read_date, slice_gap, slice_index, actual_avg, forecast_avg
    FROM a JOIN f USING (house_id, read_date, slice_gap, slice_index)""",
    rounded="actual_avg forecast_avg",
)
def _(spark, sf_dir):
    return fc.actual_vs_forecast(*house_series(spark, sf_dir), _SERIES_KEYS)


@query(
    "union_series",
    f"""{_NAIVE} SELECT house_id, read_date, slice_gap, slice_index, actual_avg AS avg, 'actual' AS series FROM a
    UNION ALL SELECT house_id, read_date, slice_gap, slice_index, forecast_avg, 'forecast' FROM f""",
    rounded="avg",
)
def _(spark, sf_dir):
    actual, forecast = house_series(spark, sf_dir)
    return fc.union_series(
        actual.withColumnRenamed("actual_avg", "avg"), forecast.withColumnRenamed("forecast_avg", "avg")
    )


_LABELS = f"""{_NAIVE}, labels_ AS (SELECT house_id, {sql.label()} AS label FROM a UNION SELECT house_id, {sql.label()} FROM f)"""


def label_union(spark, sf_dir) -> DataFrame:
    label = fs.slice_label("read_date", "slice_gap", "slice_index").alias("label")
    actual, forecast = house_series(spark, sf_dir)
    return actual.select("house_id", label).unionByName(forecast.select("house_id", label)).distinct()


@query("union_labels", f"{_LABELS} SELECT house_id, label FROM labels_")
def _(spark, sf_dir):
    return label_union(spark, sf_dir)


@query(
    "sorted_labels",
    f"""{_LABELS} SELECT house_id, label,
    CAST(row_number() OVER (PARTITION BY house_id ORDER BY label) - 1 AS INT) AS position FROM labels_""",
)
def _(spark, sf_dir):
    return fc.sorted_labels(label_union(spark, sf_dir))


@query(
    "series_stats",
    f"""{_NAIVE} SELECT house_id, count(*) AS count, avg(actual_avg) AS mean, var_pop(actual_avg) AS variance,
    stddev_pop(actual_avg) AS standard_deviation FROM a GROUP BY 1""",
    rounded="mean variance standard_deviation",
)
def _(spark, sf_dir):
    return fc.series_stats(house_series(spark, sf_dir)[0], ["house_id"], "actual_avg")


QUALITY_SQL = f"""WITH {DENSE}, {sql.slices(DIRECT_WINDOWS + DERIVED_WINDOWS)}, {sql.rollup('house', 'h')},
a AS (SELECT house_id, slice_gap, slice_index, read_date, {sql.SAFE_AVG} AS v FROM h),
p AS (SELECT house_id, slice_gap, slice_index, avg(v) AS f FROM a GROUP BY ALL),
j AS MATERIALIZED (SELECT a.slice_gap, v, f FROM a JOIN p USING (house_id, slice_gap, slice_index)),
u AS (SELECT slice_gap, v AS x FROM j UNION ALL SELECT slice_gap, f FROM j),
s AS (SELECT slice_gap, avg(x) AS m, var_samp(x) AS var, stddev_samp(x) AS sd FROM u GROUP BY 1)
SELECT slice_gap, 'v0' AS version, count(*) AS count, any_value(m) AS mean, any_value(var) AS variance,
  any_value(sd) AS standard_deviation, avg(pow((v - m) / sd - (f - m) / sd, 2)) AS mse
FROM j JOIN s USING (slice_gap) GROUP BY slice_gap"""


@query("forecast_quality", QUALITY_SQL, rounded="mean variance standard_deviation mse")
def forecast_quality_rows(spark, sf_dir):
    return fc.forecast_quality(w.rollup(w.all_windows(loads(spark, sf_dir, "dense")), "house"))
