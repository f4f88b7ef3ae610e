"""Measurement queries over readings, orders and line items seen as metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions.slices import gateway_of, int_div
from meterflow.functions.text import arrow_pct, format_number, parse_size, percent_change
from meterflow.operators import measure as m
from meterflow.operators import windows as w
from meterflow.plans import sql
from meterflow.plans.catalog_slices import DENSE, WIDE, dense_log, loads
from meterflow.plans.registry import query
from meterflow.schemas import DEVICE
from meterflow.sinks.tables import device_view
from meterflow.sources.driver_tables import driver_readings, load_table

_STEP = ["day", "houses"]
_JOINED = f"WITH {WIDE}, {sql.SAMPLES}, {sql.STEPS}, {sql.IN_STEP}"


def samples(spark, sf_dir) -> DataFrame:
    return m.samples_from_readings(driver_readings(spark, sf_dir))


def joined(spark, sf_dir) -> DataFrame:
    readings = driver_readings(spark, sf_dir)
    return m.join_segments(m.samples_from_readings(readings), m.steps_from_readings(readings), 600)


@query("join_segments", f"{_JOINED} SELECT day, houses, epoch, gateway_id, cap, lat FROM joined")
def _(spark, sf_dir):
    return joined(spark, sf_dir).select("day", "houses", "epoch", "gateway_id", "cap", "lat")


@query(
    "segment_percentiles",
    f"""{_JOINED} SELECT day, houses, max(cap) AS cap_max, max(lat) AS lat_max, max(gwcap) AS gwcap_max, count(*) AS n_samples,
    quantile_cont(cap, 0.5) AS cap_p50, quantile_cont(cap, 0.95) AS cap_p95,
    quantile_cont(lat, 0.5) AS lat_p50, quantile_cont(lat, 0.95) AS lat_p95 FROM joined GROUP BY 1, 2""",
    rounded="cap_max lat_max gwcap_max cap_p50 cap_p95 lat_p50 lat_p95",
)
def _(spark, sf_dir):
    return m.segment_percentiles(joined(spark, sf_dir), _STEP)


def _ends(column: str) -> str:
    return f"""{_JOINED}, e AS (SELECT day, houses, count(*) AS points, min(epoch) AS e0, max(epoch) AS e1,
    min({column}) AS v0, max({column}) AS v1 FROM joined WHERE {column} IS NOT NULL GROUP BY 1, 2)"""


@query(
    "segment_endpoints",
    f"""{_ends('wan_rx')} SELECT day, houses, e0 AS first_epoch, v0 AS first_value, e1 AS last_epoch, v1 AS last_value, points FROM e""",
)
def _(spark, sf_dir):
    return m.segment_endpoints(joined(spark, sf_dir), "wan_rx", _STEP)


@query(
    "counter_rate",
    f"{_ends('ack')} SELECT day, houses, CASE WHEN points >= 2 THEN (v1 - v0) / greatest(e1 - e0, 1e-9) END AS per_s FROM e",
    rounded="per_s",
)
def _(spark, sf_dir):
    return m.counter_rate(joined(spark, sf_dir), "ack", _STEP)


@query(
    "wan_rate",
    f"""{_ends('wan_rx')} SELECT day, houses,
    CASE WHEN points >= 2 THEN (v1 - v0) / 1024 / greatest((e1 - e0) / 60, 1e-9) END AS kb_per_min FROM e""",
    rounded="kb_per_min",
)
def _(spark, sf_dir):
    return m.wan_rate(joined(spark, sf_dir), "wan_rx", _STEP)


# Runs are order priorities, load levels are customers' nations; a metric is a mean price per run and level.
_RUNS = """runs AS MATERIALIZED (
  SELECT o_orderpriority AS run_id, c_nationkey + 1 AS houses, (c_nationkey + 1) * 10 AS msg_per_s,
         avg(o_totalprice) / 1000 AS lat, CASE WHEN o_orderpriority <> '1-URGENT' THEN count(*) / 10.0 END AS cap
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def runs(spark, sf_dir) -> DataFrame:
    orders, customer = load_table(spark, sf_dir, "orders"), load_table(spark, sf_dir, "customer")
    houses = F.col("c_nationkey") + 1
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_orderpriority").alias("run_id"), houses.alias("houses"), (houses * 10).alias("msg_per_s"))
        .agg((F.avg("o_totalprice") / 1000).alias("lat"), (F.count("*") / 10.0).alias("cap"))
        .withColumn("cap", F.when(F.col("run_id") != "1-URGENT", F.col("cap")))
    )


def _two(x: str) -> str:
    return f"CAST(printf('%.2f', round({x}, 9)) AS DOUBLE)"


def _ci(c: str) -> str:
    cases = " ".join(f"WHEN {df} THEN {t}" for df, t in m.T95.items())
    half = f"(CASE count({c}) - 1 {cases} ELSE 1.96 END) * stddev_samp({c}) / sqrt(count({c}))"
    return f"""{_two(f'avg({c})')} AS {c}_mean,
    CASE WHEN count({c}) > 1 THEN {_two(f'stddev_pop({c})')} ELSE 0 END AS {c}_std,
    CASE WHEN count({c}) > 1 THEN {_two(half)} END AS {c}_ci95"""


@query(
    "runs_summary",
    f"""WITH {_RUNS} SELECT houses, min(msg_per_s) AS msg_per_s, count(DISTINCT run_id) AS n_runs, {_ci('lat')}, {_ci('cap')}
    FROM runs GROUP BY 1""",
)
def _(spark, sf_dir):
    return m.runs_summary(runs(spark, sf_dir), ["lat", "cap"])


@query(
    "numeric_level_sort",
    f"""WITH {_RUNS} SELECT CAST(houses AS VARCHAR) AS level, count(*) AS runs FROM runs GROUP BY 1 ORDER BY CAST(level AS INT)""",
)
def _(spark, sf_dir):
    levels = runs(spark, sf_dir).groupBy(F.col("houses").cast("string").alias("level")).agg(F.count("*").alias("runs"))
    return m.numeric_level_sort(levels, "level")


# --- latency and checks on the stored view -----------------------------------------------------------------------

_VIEW = f"WITH {DENSE}, {sql.flushes(120)}, {sql.device_view()}"
_VALID = f"""{_VIEW}, valid AS MATERIALIZED (SELECT *, first_written_at - event_ts AS latency_ms FROM device
  WHERE event_ts > 0 AND first_written_at > 0 AND first_written_at - event_ts BETWEEN 0 AND 3600000)"""


def stored(spark, sf_dir) -> DataFrame:
    return device_view(dense_log(spark, sf_dir))


@query("filter_valid_latency", f"{_VALID} SELECT {sql.IDS}, read_date, slice_index, latency_ms FROM valid")
def _(spark, sf_dir):
    return m.valid_latency(stored(spark, sf_dir)).select(*DEVICE, "read_date", "slice_index", "latency_ms")


@query(
    "latency_report",
    f"""{_VALID} SELECT count(*) AS samples, avg(latency_ms) AS mean_ms, quantile_cont(latency_ms, 0.5) AS p50_ms,
    quantile_cont(latency_ms, 0.95) AS p95_ms, quantile_cont(latency_ms, 0.99) AS p99_ms, max(latency_ms) AS max_ms,
    min(latency_ms) AS min_ms FROM valid""",
    rounded="mean_ms p50_ms p95_ms p99_ms",
)
def _(spark, sf_dir):
    return m.latency_report(stored(spark, sf_dir))


@query("duplicate_check", f"{_VIEW} SELECT CAST(count(*) - count(DISTINCT ({sql.IDS}, read_date, slice_gap, slice_index)) AS BIGINT) AS duplicates FROM device")
def _(spark, sf_dir):
    return m.duplicate_check(stored(spark, sf_dir))


@query("duplicate_check_log", f"""WITH {DENSE}, {sql.flushes(120)}
  SELECT CAST(count(*) - count(DISTINCT ({sql.IDS}, read_date, slice_gap, slice_index)) AS BIGINT) AS duplicates FROM flushes""")
def _(spark, sf_dir):
    return m.duplicate_check(dense_log(spark, sf_dir))


@query(
    "window_check",
    f"""WITH {DENSE}, {sql.slices([1, 5, 10, 15, 30])}, e AS (
      SELECT {sql.IDS}, slice_gap, CAST(sum(value_count) AS BIGINT) AS count, sum(value_sum) AS sum FROM slices GROUP BY {sql.IDS}, slice_gap),
    x AS (SELECT *, {_two('sum / count')} AS avg FROM e)
    SELECT *, abs(avg - 45) < 0.01 AND abs(count - 200) < 0.5 AS ok FROM x""",
    rounded="sum",
)
def _(spark, sf_dir):
    table = w.multi_window(loads(spark, sf_dir, "dense"))
    return m.window_check(table, F.lit(200), F.lit(45.0), DEVICE)


@query(
    "slice_gap_check",
    f"""WITH {DENSE}, {sql.slices([30])} SELECT house_id, read_date,
    CAST(max(slice_index) - min(slice_index) + 1 - count(DISTINCT slice_index) AS BIGINT) AS missing
    FROM slices WHERE slice_index BETWEEN 4 AND 44 GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    table = w.window_slices(loads(spark, sf_dir, "dense"), 30)
    return m.slice_gap_check(table, ["house_id", "read_date"], 4, 44)


# --- gateways ----------------------------------------------------------------------------------------------------


@query(
    "rate_over_time",
    f"""WITH {WIDE}, {sql.SAMPLES} SELECT gateway_id, epoch, tup,
    CASE WHEN epoch > e0 THEN (tup - t0) / (epoch - e0) END AS rate FROM (
      SELECT gateway_id, epoch, tup, min(epoch) OVER win AS e0, min(tup) OVER win AS t0 FROM samples
      WINDOW win AS (PARTITION BY gateway_id ORDER BY epoch RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))""",
    rounded="rate",
)
def _(spark, sf_dir):
    return m.rate_over_time(samples(spark, sf_dir), "tup", 3600)


_TOTALS = f"""WITH {WIDE}, {sql.SAMPLES}, g AS (
  SELECT gateway_id, sum(lat) AS total, max(lat) AS highest, count(*) AS samples FROM samples GROUP BY 1)"""


@query(
    "gateway_totals",
    f"""{_TOTALS} SELECT gateway_id, total, highest, samples FROM g
    UNION ALL SELECT 'all', sum(total), max(highest), count(*) FROM g""",
    rounded="total highest",
)
def _(spark, sf_dir):
    totals = m.gateway_totals(samples(spark, sf_dir), "lat")
    fleet = m.fleet_totals(totals).select(
        F.lit("all").alias("gateway_id"), "total", "highest", F.col("live_gateways").alias("samples")
    )
    return totals.unionByName(fleet)


@query(
    "reduction_pct",
    f"""WITH {DENSE}, {sql.slices([1, 5, 10, 15, 30, 60, 120])}
    SELECT slice_gap, count(*) AS rows_out, CAST(sum(value_count) AS BIGINT) AS rows_in,
    100 * (1 - count(*) / sum(value_count)) AS reduction FROM slices GROUP BY 1""",
    rounded="reduction",
)
def _(spark, sf_dir):
    counts = w.all_windows(loads(spark, sf_dir, "dense")).groupBy("slice_gap").agg(
        F.count("*").alias("rows_out"), F.sum("value_count").alias("rows_in")
    )
    return counts.withColumn("reduction", m.reduction_pct(F.col("rows_in"), F.col("rows_out")))


_LAT = f"""lat AS MATERIALIZED (SELECT event_id, event_ms, {sql.gateway()} AS gateway_id, value AS latency_ms FROM loads)"""
_EMA = f"""WITH RECURSIVE {WIDE}, {_LAT}, {sql.baseline(0.2, 'gateway_id', 'lat', 'latency_ms')}"""
FLUSH_MS = 3_600_000


def latencies(spark, sf_dir) -> DataFrame:
    return loads(spark, sf_dir).select(
        "event_id", "event_ms", gateway_of("house_id").alias("gateway_id"), F.col("value").alias("latency_ms")
    )


@query("latency_ema", f"{_EMA} SELECT event_id, gateway_id, mean_after AS ema_ms FROM fold", rounded="ema_ms")
def _(spark, sf_dir):
    return m.latency_ema(latencies(spark, sf_dir), 0.2).select("event_id", "gateway_id", "ema_ms")


@query(
    "bolt_capacity",
    f"""{_EMA}, f AS (SELECT gateway_id, event_ms // {FLUSH_MS} AS flush_id, arg_max(mean_after, rn) AS ema_ms,
      max(x) AS max_ms, count(*) AS processed FROM fold GROUP BY 1, 2)
    SELECT *, least(1.0::DOUBLE, processed * ema_ms / {FLUSH_MS}) AS capacity FROM f""",
    rounded="ema_ms max_ms capacity",
)
def _(spark, sf_dir):
    return m.flush_latency(latencies(spark, sf_dir), 0.2, FLUSH_MS)


@query(
    "idle_intervals",
    f"""WITH {WIDE}, g AS (SELECT {sql.gateway()} AS gateway_id, event_ms AS idle_to,
      lag(event_ms) OVER (PARTITION BY house_id // 5 ORDER BY event_ms) AS idle_from FROM readings)
    SELECT gateway_id, idle_from, idle_to, idle_to - idle_from AS idle_ms FROM g WHERE idle_to - idle_from >= 3600000""",
)
def _(spark, sf_dir):
    activity = driver_readings(spark, sf_dir).select(gateway_of("house_id").alias("gateway_id"), "event_ms")
    return m.idle_intervals(activity, 3600)


@query(
    "latest_by_name",
    f"""WITH {WIDE} SELECT {sql.gateway()} AS name, max(event_ms) AS reported_ms, arg_max(event_id, (event_ms, event_id)) AS event_id,
    arg_max(value, (event_ms, event_id)) AS speed FROM readings GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = driver_readings(spark, sf_dir).select(
        gateway_of("house_id").alias("name"), F.col("event_ms").alias("reported_ms"), "event_id", F.col("value").alias("speed")
    )
    return m.latest_by_name(rows, "name", ["reported_ms", "event_id"])


@query(
    "source_totals",
    f"""WITH {WIDE}, l AS (SELECT house_id, arg_max(value, event_ms) AS value, arg_max(event_id, event_ms) AS id,
      arg_max(plug_id, event_ms) AS plug, arg_max(property, event_ms) AS property FROM readings GROUP BY 1)
    SELECT sum(value) AS speed, CAST(sum(id) AS BIGINT) AS total, CAST(sum(id * property) AS BIGINT) AS load,
    CAST(sum(plug) AS BIGINT) AS queue, CAST(sum(property) AS BIGINT) AS success, CAST(sum(1 - property) AS BIGINT) AS fail,
    bool_and(property = 1) AS all_connected FROM l""",
    rounded="speed",
)
def _(spark, sf_dir):
    status = driver_readings(spark, sf_dir).select(
        F.col("house_id").alias("name"),
        "event_ms",
        F.col("value").alias("speed"),
        F.col("event_id").alias("total"),
        (F.col("event_id") * F.col("property")).alias("load"),
        F.col("plug_id").alias("queue"),
        F.col("property").alias("success"),
        (1 - F.col("property")).alias("fail"),
        (F.col("property") == 1).alias("connected"),
    )
    return m.source_totals(m.latest_by_name(status, "name", ["event_ms"]))


# --- outages -----------------------------------------------------------------------------------------------------

_QUEUE = f"""WITH {WIDE}, q0 AS (SELECT CAST(event_ms // 86400000 AS INT) AS session_id, event_id, event_ms / 1000.0 AS epoch,
    (event_ms % 86400000) // 3600000 AS hour, value, (event_ms - event_ms % 86400000) / 1000.0 AS midnight FROM readings),
q AS MATERIALIZED (SELECT *, CAST(CASE WHEN hour BETWEEN 2 AND 4 THEN floor(value) WHEN hour = 5 THEN floor(value / 10) ELSE 0 END AS BIGINT)
    AS queue_size FROM q0)"""


def queue_samples(spark, sf_dir) -> DataFrame:
    return m.queue_samples_from_readings(driver_readings(spark, sf_dir))


_OUTAGE = f"""{_QUEUE}, d AS (
  SELECT session_id, CAST(max(queue_size) FILTER (WHERE epoch >= midnight + 7200) AS BIGINT) AS max_queue,
    min(epoch) FILTER (WHERE epoch >= midnight + 18000 AND queue_size = 0) - (min(midnight) + 18000) AS recovery_s,
    max(event_id) - min(event_id) AS enqueued,
    (max(event_id) - arg_max(queue_size, epoch)) - (min(event_id) - arg_min(queue_size, epoch)) AS drained,
    arg_max(queue_size, epoch) - arg_min(queue_size, epoch) AS stuck,
    2 * (max(event_id) - min(event_id)) AS attempts,
    (2 * max(event_id) - arg_max(queue_size, epoch)) - (2 * min(event_id) - arg_min(queue_size, epoch)) AS published
  FROM q GROUP BY 1),
r AS (SELECT *, round(CASE WHEN enqueued <> 0 THEN 100.0 * greatest(0, enqueued - drained - stuck) / enqueued
      WHEN attempts <> 0 THEN 100.0 * (attempts - published - stuck) / attempts END, 2) AS loss_pct FROM d)"""


@query("outage_report", f"{_OUTAGE} SELECT * FROM r", rounded="recovery_s")
def _(spark, sf_dir):
    return m.outage_report(queue_samples(spark, sf_dir), ["session_id"])


@query(
    "outage_model",
    f"""{_OUTAGE} SELECT session_id, recovery_s, CAST(180 * 5 * 8 AS DOUBLE) AS model_queue,
    7200.0::DOUBLE / recovery_s AS drain_per_s, recovery_s / 7200 AS s_per_batch, 7200 / recovery_s > 40 / 60.0 AS converges FROM r""",
    rounded="recovery_s drain_per_s s_per_batch",
)
def _(spark, sf_dir):
    report = m.outage_report(queue_samples(spark, sf_dir), ["session_id"])
    model = m.outage_model(report, gateways=8, windows=5, flush_s=60, outage_s=10_800)
    return model.select("session_id", "recovery_s", "model_queue", "drain_per_s", "s_per_batch", "converges")


@query(
    "stable_run",
    f"""{_QUEUE}, g AS (SELECT session_id, epoch, queue_size = 0 AND event_id > coalesce(lag(event_id) OVER win, 0) AS good FROM q
      WINDOW win AS (PARTITION BY session_id ORDER BY epoch)),
    s AS (SELECT session_id, epoch, good AND lag(good) OVER win AND lag(good, 2) OVER win AS run FROM g
      WINDOW win AS (PARTITION BY session_id ORDER BY epoch))
    SELECT session_id, min(epoch) AS stable_at FROM s WHERE run GROUP BY 1""",
)
def _(spark, sf_dir):
    return m.stable_run(queue_samples(spark, sf_dir).select("session_id", "epoch", "queue_size", "tuples"), "session_id")


# --- containers and comparisons ----------------------------------------------------------------------------------

_STATS = f"""WITH {WIDE}, st AS (SELECT event_ms // 86400000 AS sample, value AS cpu, CASE WHEN plug_id = 0 THEN value * 1024 ELSE value * 2 END AS mem
  FROM readings WHERE house_id % 7 <> 6),
t AS MATERIALIZED (SELECT sample, count(*) AS containers, sum(cpu) AS cpu_sum, max(cpu) AS cpu_max, sum(mem) AS mem_sum_mb,
  max(mem) AS mem_max_mb FROM st GROUP BY 1)"""


def container_samples(spark, sf_dir) -> DataFrame:
    return driver_readings(spark, sf_dir).select(
        int_div("event_ms", 86_400_000).alias("sample"),
        F.concat(F.when(F.col("house_id") % 7 == 6, "db-").otherwise(""), gateway_of("house_id"), F.lit("-"), F.col("plug_id")).alias("container"),
        F.concat(F.col("value").cast("string"), F.lit("%")).alias("cpu_perc"),
        F.when(F.col("plug_id") == 0, F.concat(F.col("value").cast("string"), F.lit("GiB / 500GiB")))
        .when(F.col("plug_id") == 1, F.concat((F.col("value") * 2).cast("string"), F.lit("MB / 1GB")))
        .otherwise(F.concat((F.col("value") * 2).cast("string"), F.lit("MiB / 1GiB")))
        .alias("mem_usage"),
    )


@query("container_totals", f"{_STATS} SELECT * FROM t", rounded="cpu_sum mem_sum_mb mem_max_mb")
def _(spark, sf_dir):
    return m.container_totals(container_samples(spark, sf_dir))


@query(
    "container_summary",
    f"""{_STATS} SELECT count(*) AS samples, arg_max(containers, sample) AS gateways, avg(cpu_max) AS cpu_busiest_avg, max(cpu_max) AS cpu_busiest_peak,
    avg(mem_max_mb) AS mem_busiest_avg_mb, max(mem_max_mb) AS mem_busiest_peak_mb, avg(mem_sum_mb) AS mem_sum_avg_mb,
    max(mem_sum_mb) AS mem_sum_peak_mb FROM t""",
    rounded="cpu_busiest_avg mem_busiest_avg_mb mem_busiest_peak_mb mem_sum_avg_mb mem_sum_peak_mb",
)
def _(spark, sf_dir):
    return m.container_summary(m.container_totals(container_samples(spark, sf_dir)))


@query(
    "parse_size",
    """SELECT o_orderkey, text, o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1e6 WHEN 'O' THEN 1024 ELSE 1 END AS bytes FROM (
      SELECT *, o_orderkey || CASE o_orderstatus WHEN 'F' THEN 'MB' WHEN 'O' THEN 'kiB' ELSE 'parts' END AS text,
             CAST(o_orderkey AS DOUBLE) AS o_totalprice FROM (SELECT o_orderkey, o_orderstatus FROM orders))""",
)
def _(spark, sf_dir):
    unit = F.when(F.col("o_orderstatus") == "F", "MB").when(F.col("o_orderstatus") == "O", "kiB").otherwise("parts")
    rows = load_table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_orderkey"), unit).alias("text"))
    return rows.select("o_orderkey", "text", parse_size("text").alias("bytes"))


# Two systems: finished and open line items; metrics are line numbers, windows are ship months. Nearly every month has one of them only.
_SYSTEMS = """m AS (SELECT CAST(l_linenumber AS VARCHAR) AS metric, strftime(l_shipdate, '%Y-%m') AS window_, l_linestatus,
    sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
c AS MATERIALIZED (SELECT metric, window_, a.value AS base_value, b.value AS other_value,
    CASE WHEN a.value <> 0 THEN (b.value - a.value) / a.value * 100 END AS change_pct
  FROM (SELECT * FROM m WHERE l_linestatus = 'F') a
  FULL JOIN (SELECT * FROM m WHERE l_linestatus <> 'F') b USING (metric, window_))"""
_ARROW = """CASE WHEN change_pct IS NULL THEN '—' ELSE CASE WHEN change_pct < 0 THEN '↓ ' ELSE '↑ ' END ||
  CASE WHEN abs(change_pct) > 99 THEN printf('%.2f', abs(change_pct)) ELSE printf('%.1f', abs(change_pct)) END || '%' END"""


def _number(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'NA' WHEN abs({x}) >= 1000 THEN format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))
      WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR)
      ELSE regexp_replace(printf('%.3f', {x}), '\\.?0+$', '') END"""


def systems(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    metrics = load_table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_linenumber").cast("string").alias("metric"), F.date_format("l_shipdate", "yyyy-MM").alias("window"), "l_linestatus"
    ).agg(F.sum("l_quantity").alias("value"))
    base = metrics.where("l_linestatus = 'F'").drop("l_linestatus")
    return base, metrics.where("l_linestatus <> 'F'").drop("l_linestatus")


COMPARISON_SQL = f"""WITH {_SYSTEMS} SELECT metric, window_ AS "window", base_value, other_value, change_pct,
  {_ARROW} AS change_text, {_number('base_value')} AS base_text, {_number('other_value')} AS other_text FROM c"""


@query("compare_systems", COMPARISON_SQL, rounded="change_pct")
def compare_rows(spark, sf_dir):
    return m.compare_systems(*systems(spark, sf_dir))


_PRICES = """p AS MATERIALIZED (SELECT o_orderkey, o_totalprice / 300 AS a, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 7 - 20000 END AS b,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_totalprice / 300 END AS base FROM orders),
c AS (SELECT *, CASE WHEN base <> 0 THEN (b - base) / base * 100 END AS change_pct FROM p)"""


def prices(spark, sf_dir) -> DataFrame:
    price = F.col("o_totalprice")
    return load_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (price / 300).alias("a"),
        F.when(F.col("o_orderstatus") != "P", price / 7 - 20000).alias("b"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 0.0).otherwise(price / 300).alias("base"),
    )


@query("percent_change", f"WITH {_PRICES} SELECT o_orderkey, change_pct FROM c", rounded="change_pct")
def _(spark, sf_dir):
    return prices(spark, sf_dir).select("o_orderkey", percent_change("base", "b").alias("change_pct"))


@query("arrow_pct", f"WITH {_PRICES} SELECT o_orderkey, {_ARROW} AS change FROM c")
def _(spark, sf_dir):
    return prices(spark, sf_dir).select("o_orderkey", arrow_pct("base", "b").alias("change"))


@query("format_number", f"WITH {_PRICES} SELECT o_orderkey, {_number('a')} AS a_text, {_number('b')} AS b_text FROM c")
def _(spark, sf_dir):
    return prices(spark, sf_dir).select(
        "o_orderkey", format_number("a").alias("a_text"), format_number("b").alias("b_text")
    )


@query(
    "wan_delta",
    """WITH s AS (SELECT o_custkey, o_orderkey AS taken_at, o_totalprice * 1e6 AS rx FROM orders)
    SELECT o_custkey, CASE WHEN count(*) > 1 THEN arg_max(rx, taken_at) - arg_min(rx, taken_at) ELSE max(rx) END AS wan_bytes
    FROM s GROUP BY 1""",
    rounded="wan_bytes",
)
def _(spark, sf_dir):
    net = F.concat(F.format_string("%.2f", F.col("o_totalprice")), F.lit("MB / 1kB"))
    rows = load_table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("taken_at"), m.received_bytes(net).alias("rx_bytes")
    )
    return m.wan_delta(rows, ["o_custkey"])


