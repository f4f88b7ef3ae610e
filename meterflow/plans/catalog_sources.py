"""Source parsers over text that Spark derives from the driver tables, and stored-table round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions.slices import gateway_of, int_div
from meterflow.operators import measure as m
from meterflow.operators import windows as w
from meterflow.plans import sql
from meterflow.plans.catalog_measure import COMPARISON_SQL, compare_rows
from meterflow.plans.catalog_slices import DENSE, QUALITY_SQL, WIDE, device_slices, forecast_quality_rows, loads
from meterflow.plans.registry import query
from meterflow.operators.forecast import median_forecast
from meterflow.schemas import DEVICE, HOUSE, HOUSEHOLD, LEVEL_KEYS, SLICE
from meterflow.session import scratch_path
from meterflow.sinks import exports, tables
from meterflow.sources import batches as sb
from meterflow.sources import measurements as sm
from meterflow.sources.driver_tables import driver_readings, load_table
from meterflow.sources.readings import parse_readings
from meterflow.sources.routes import parse_routes


def reading_lines(readings: DataFrame) -> DataFrame:
    """Readings as raw text lines; non-load ones carry an unreadable value, and ids are padded."""
    value = F.when(F.col("property") == 0, "n/a").otherwise(F.col("value").cast("string"))
    fields = ["event_id", int_div("event_ms", 1000), value, "property", "plug_id", "household_id"]
    return readings.select(F.concat_ws(",", *fields, F.concat(F.lit(" "), F.col("house_id"), F.lit(" "))).alias("value"))


SCAN_SQL = f"""WITH {WIDE} SELECT event_id, event_ms // 1000 * 1000 AS event_ms, value, property, plug_id, household_id, house_id
  FROM loads"""


@query("scan_readings", SCAN_SQL)
def _(spark, sf_dir):
    lines = reading_lines(driver_readings(spark, sf_dir))
    short = lines.select(F.substring_index("value", ",", 6).alias("value"))
    return parse_readings(lines.unionByName(short))


# --- envelopes ---------------------------------------------------------------------------------------------------

_LOG = f"WITH {WIDE}, {sql.flushes(30)}"
_LOG_COLUMNS = f"{sql.IDS}, read_date, slice_gap, slice_index, flush_ts, value_count, value_sum, event_ts"


def wide_log(spark, sf_dir, gap: int = 30) -> DataFrame:
    return w.flush_log(loads(spark, sf_dir), gap)


@query("scan_batches", f"{_LOG} SELECT {_LOG_COLUMNS} FROM flushes", rounded="value_sum")
def _(spark, sf_dir):
    messages = sb.encode_payloads(sb.build_envelopes(wide_log(spark, sf_dir)))
    broken = messages.select("gatewayId", F.lit("not gzip").cast("binary").alias("payload"))
    rows = sb.explode_envelopes(sb.decode_payloads(messages.unionByName(broken)))
    return rows.drop("batch_id")


_BY_FLUSH = f"{_LOG} SELECT {sql.gateway()} AS gateway_id, flush_ts, slice_gap, count(*) AS records FROM flushes GROUP BY ALL"


def _by_flush(envelopes: DataFrame) -> DataFrame:
    return envelopes.groupBy(
        F.col("gatewayId").alias("gateway_id"),
        F.col("flushTimestamp").alias("flush_ts"),
        F.col("windowSizeMin").alias("slice_gap"),
    ).agg(F.sum(F.size("deviceRecords")).alias("records"))


@query("scan_outbox", _BY_FLUSH)
def _(spark, sf_dir):
    queued = sb.build_envelopes(wide_log(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("value"))
    blank = queued.select(F.lit("  ").alias("value"))
    return _by_flush(sb.parse_envelopes(queued.unionByName(blank)))


@query("write_batches", _BY_FLUSH)
def _(spark, sf_dir):
    path = scratch_path(spark, "envelopes")
    exports.write_batches(wide_log(spark, sf_dir), path)
    return _by_flush(sb.read_envelopes(spark, path))


@query(
    "known_windows_only",
    f"""{_LOG} SELECT slice_gap, count(*) AS records, CAST(sum(value_count) AS BIGINT) AS readings FROM flushes GROUP BY 1""",
)
def _(spark, sf_dir):
    mixed = wide_log(spark, sf_dir).unionByName(wide_log(spark, sf_dir, 7))
    rows = sb.explode_envelopes(sb.known_windows_only(sb.build_envelopes(mixed)))
    return rows.groupBy("slice_gap").agg(F.count("*").alias("records"), F.sum("value_count").alias("readings"))


# --- documents and logs ------------------------------------------------------------------------------------------


@query("scan_routes", "SELECT CAST(s_suppkey AS INT) AS house_id, 'https://alerts.example/' || s_name AS url FROM supplier")
def _(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    document = F.concat(
        F.lit('{"default": null, "routes": {" '), key, F.lit(' ": "https://alerts.example/'), F.col("s_name"),
        F.lit('", "n/a": "https://alerts.example/none", "9'), key, F.lit('": "  "}}'),
    )
    return parse_routes(load_table(spark, sf_dir, "supplier").select(document.alias("value")))


@query(
    "scan_series",
    f"WITH {WIDE}, {sql.SAMPLES} SELECT epoch, cap, lat, ack, tup, gwcap, wan_rx FROM samples",
)
def _(spark, sf_dir):
    samples = m.samples_from_readings(driver_readings(spark, sf_dir))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in sm.SERIES_COLUMNS]
    lines = samples.select(F.concat_ws("\t", *cells).alias("value"))
    header = lines.select(F.lit("\t".join(sm.SERIES_COLUMNS)).alias("value")).distinct()
    return sm.parse_series(lines.unionByName(header))


def _iso(ms: str) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@query(
    "scan_alert_log",
    f"""WITH {DENSE} SELECT event_id AS alert_id, {sql.IDS}, CASE WHEN plug_id <> 3 THEN event_ms / 1000.0 END AS ts
    FROM loads WHERE value >= 100""",
)
def _(spark, sf_dir):
    rows = loads(spark, sf_dir, "dense")
    ids = F.format_string("house=%d hh=%d plug=%d", *[F.col(k) for k in DEVICE])
    stamp = F.when(F.col("plug_id") != 3, F.concat(_iso("event_ms"), F.lit(" "))).otherwise("")
    alert = F.concat(stamp, F.lit("[gw-01] ALERT WARNING "), ids, F.lit(" reading is high"))
    flush = F.concat(stamp, F.lit("[gw-01] flush: 5 windows, "), ids)
    line = F.when(F.col("value") >= 100, alert).otherwise(flush)
    return sm.parse_alert_log(rows.select(F.col("event_id").alias("alert_id"), line.alias("value")))


@query(
    "scan_ground_truth",
    f"""WITH {DENSE}, s AS (SELECT *, event_ms // 86400000 * 86400 AS start FROM loads WHERE value >= 100)
    SELECT start, start + 86400 AS "end", event_ms // 1000 AS ts, {sql.IDS}, value FROM s""",
)
def _(spark, sf_dir):
    start = int_div("event_ms", 86_400_000) * 86_400
    spike = F.struct(
        int_div("event_ms", 1000).alias("ts"),
        F.col("house_id").alias("houseId"),
        F.col("household_id").alias("householdId"),
        F.col("plug_id").alias("plugId"),
        "value",
    )
    rows = loads(spark, sf_dir, "dense").where("value >= 100")
    documents = rows.groupBy(*DEVICE, start.alias("start")).agg(F.collect_list(spike).alias("spikes"))
    text = F.to_json(F.struct("start", (F.col("start") + 86_400).alias("end"), "spikes"))
    return sm.parse_ground_truth(documents.select(text.alias("value"))).drop("position")


@query(
    "scan_metric_csv",
    """SELECT o_orderpriority || o_custkey AS metric, '600' AS "window",
    arg_max_null(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, o_orderkey) AS value FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", "NA").otherwise(F.col("o_totalprice").cast("string"))
    raw = load_table(spark, sf_dir, "orders").select(
        F.concat("o_orderpriority", "o_custkey").alias("metric"), F.lit("600").alias("window"), text.alias("value"), "o_orderkey"
    )
    return sm.last_metrics(sm.typed_metrics(raw), "o_orderkey")


@query(
    "scan_container_stats",
    f"""WITH {WIDE}, d AS (SELECT event_ms // 86400000 AS day, {sql.gateway()} AS container, value FROM readings)
    SELECT container, count(*) AS rows, sum(value) AS cpu FROM d GROUP BY 1
    UNION ALL SELECT 'total', count(*), sum(total) FROM (SELECT sum(value) AS total FROM d GROUP BY day)""",
    rounded="cpu",
)
def _(spark, sf_dir):
    rows = driver_readings(spark, sf_dir)
    each = rows.select(gateway_of("house_id").alias("container"), F.concat(F.col("value"), F.lit("%")).alias("cpu_perc"))
    total = rows.groupBy(int_div("event_ms", 86_400_000)).agg(F.sum("value").alias("total"))
    stats = each.unionByName(total.select(F.lit(sm.TOTAL_ROW).alias("container"), F.col("total").cast("string").alias("cpu_perc")))
    cpu = F.regexp_replace("cpu_perc", "%", "").cast("double")
    per_container = sm.container_rows(stats).groupBy("container").agg(F.count("*").alias("rows"), F.sum(cpu).alias("cpu"))
    summed = sm.container_total(stats).agg(F.count("*").alias("rows"), F.sum("total_cpu").alias("cpu"))
    return per_container.unionByName(summed.withColumn("container", F.lit("total")))


@query(
    "scan_component_stats",
    """SELECT o_orderpriority AS topology, 'spout' AS type, 'source' AS component, CAST(1 AS BIGINT) AS executors,
      CAST(2 AS BIGINT) AS tasks, o_orderkey AS emitted, o_custkey AS transferred FROM orders
    UNION ALL SELECT o_orderpriority, 'bolt', 'merge-' || o_orderstatus, 1, 4, o_orderkey, o_custkey FROM orders""",
)
def _(spark, sf_dir):
    def component(identity: str, name: Column, tasks: int) -> Column:
        return F.array(
            F.struct(
                name.alias(identity),
                F.lit(1).alias("executors"),
                F.lit(tasks).alias("tasks"),
                F.col("o_orderkey").alias("emitted"),
                F.col("o_custkey").alias("transferred"),
            )
        )

    document = F.struct(
        F.col("o_orderpriority").alias("name"),
        component("spoutId", F.lit("source"), 2).alias("spouts"),
        component("boltId", F.concat(F.lit("merge-"), "o_orderstatus"), 4).alias("bolts"),
    )
    return sm.parse_component_stats(load_table(spark, sf_dir, "orders").select(F.to_json(document).alias("value")))


@query(
    "latest_snapshot",
    "SELECT l_returnflag AS metric, count(*) AS rows FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1",
)
def _(spark, sf_dir):
    lineitem, path = load_table(spark, sf_dir, "lineitem"), scratch_path(spark, "snapshots")
    for status in ("O", "F"):
        counts = lineitem.where(F.col("l_linestatus") == status).groupBy(F.col("l_returnflag").alias("metric")).agg(
            F.count("*").alias("rows")
        )
        counts.repartition(1).write.mode("append").option("header", True).csv(path)
    return sm.latest_snapshot(spark, f"{path}/*.csv", header="true").select("metric", F.col("rows").cast("long").alias("rows"))


# --- stored tables -----------------------------------------------------------------------------------------------


@query(
    "scan_tables",
    f"WITH {WIDE}, {sql.slices([60])} SELECT {sql.IDS}, read_date, slice_index, value_count, value_sum FROM slices",
    rounded="value_sum",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "device")
    tables.write_slices(w.multi_window(loads(spark, sf_dir), [30, 60]), path)
    stored = spark.read.parquet(path).where(F.col("slice_gap") == 60)
    return stored.select(*DEVICE, "read_date", "slice_index", "value_count", "value_sum")


@query(
    "init_tables",
    f"""WITH {WIDE}, {sql.slices([60])} SELECT t AS name, CASE WHEN t = 'device' THEN (SELECT count(*) FROM slices) ELSE 0 END AS rows
    FROM (SELECT unnest(['device', 'household', 'house', 'forecast', 'forecast_meta_data', 'notification']) AS t)""",
)
def _(spark, sf_dir):
    root = scratch_path(spark, "tables")
    tables.init_tables(spark, root)
    rows = device_slices(spark, sf_dir, 60)
    stamped = rows.withColumns({c: F.lit(0).cast("long") for c in ("first_written_at", "updated_at")})
    stamped.select(*tables.table_schemas()["device"].fieldNames()).write.mode("append").parquet(f"{root}/device")
    tables.init_tables(spark, root)
    out = None
    for name in tables.table_schemas():
        count = tables.read_table(spark, root, name).agg(F.count("*").alias("rows")).withColumn("name", F.lit(name))
        out = count if out is None else out.unionByName(count)
    return out


_DENSE_LOG = f"{DENSE}, {sql.flushes(120)}"


def _write_log(spark, sf_dir) -> str:
    """Two batches in the wrong order, the second of them written twice."""
    log, path = w.flush_log(loads(spark, sf_dir, "dense"), 120), scratch_path(spark, "log")
    early = F.col("flush_ts") % 7_200_000 != 0
    tables.append_log(log.where(~early), path, 0)
    tables.append_log(log.where(early), path, 1)
    tables.append_log(log.where(early), path, 1)
    return path


@query(
    "upsert_device",
    f"""WITH {_DENSE_LOG}, {sql.device_view()} SELECT {sql.IDS}, read_date, slice_index, value_count, value_sum, event_ts,
    first_written_at, updated_at FROM device""",
    rounded="value_sum",
)
def _(spark, sf_dir):
    return tables.device_view(spark.read.parquet(_write_log(spark, sf_dir))).drop("slice_gap")


def _level_log(level: str) -> str:
    """Every flush round rolled up on its own; the newest row per key wins."""
    keys = ", ".join(LEVEL_KEYS[level])
    return f"""WITH {_DENSE_LOG}, l AS (SELECT {keys}, read_date, slice_gap, slice_index, flush_ts AS updated_at,
      count(*) AS value_count, sum(value_sum / value_count) AS value_sum FROM flushes GROUP BY ALL)
    SELECT {keys}, read_date, slice_gap, slice_index, arg_max(value_count, updated_at) AS value_count,
      arg_max(value_sum, updated_at) AS value_sum, max(updated_at) AS updated_at
    FROM l GROUP BY {keys}, read_date, slice_gap, slice_index"""


def _level_rows(spark, sf_dir, level: str) -> DataFrame:
    log = w.flush_log(loads(spark, sf_dir, "dense"), 120)
    rounds = log.groupBy(*LEVEL_KEYS[level], *SLICE, F.col("flush_ts").alias("updated_at")).agg(
        F.count("*").alias("value_count"), F.sum(F.col("value_sum") / F.col("value_count")).alias("value_sum")
    )
    return tables.level_view(rounds, level)


@query("replace_household", _level_log("household"), rounded="value_sum")
def _(spark, sf_dir):
    return _level_rows(spark, sf_dir, "household").select(*HOUSEHOLD, *SLICE, "value_count", "value_sum", "updated_at")


@query("replace_house", _level_log("house"), rounded="value_sum")
def _(spark, sf_dir):
    return _level_rows(spark, sf_dir, "house").select(*HOUSE, *SLICE, "value_count", "value_sum", "updated_at")


@query(
    "replace_forecast",
    f"""WITH {DENSE}, {sql.slices([60])}, {sql.rollup('house', 'h')}
    SELECT 'house' AS level, house_id || ':' || replace(read_date, '-', ':') || ':' || slice_index AS key_str, slice_gap,
      {sql.round2('CASE WHEN med > 0 THEN (a + med) / 2 ELSE a END')} AS forecast_value, CAST(2 AS BIGINT) AS updated_at
    FROM (SELECT *, median(a) OVER (PARTITION BY house_id, read_date) AS med
          FROM (SELECT *, value_sum / value_count AS a FROM h WHERE value_count > 0))""",
)
def _(spark, sf_dir):
    house = w.rollup(device_slices(spark, sf_dir, 60, "dense"), "house")
    newest = tables.forecast_rows(median_forecast(house, "house"), "house", F.lit(2))
    older = newest.withColumn("forecast_value", F.lit(0.0)).withColumn("updated_at", F.lit(1).cast("long"))
    return tables.forecast_view(newest.unionByName(older))


@query(
    "upsert_quality",
    f"SELECT *, CAST(5 AS BIGINT) AS updated_at FROM ({QUALITY_SQL})",
    rounded="mean variance standard_deviation mse",
)
def _(spark, sf_dir):
    quality = forecast_quality_rows(spark, sf_dir).withColumn("updated_at", F.lit(5).cast("long"))
    stale = quality.withColumn("updated_at", F.lit(4).cast("long")).withColumn("mse", F.lit(0.0))
    return tables.quality_view(stale.unionByName(quality))


@query(
    "export_csv",
    f"""WITH {DENSE}, {sql.slices([120])}, {sql.rollup('house', 'h')}, a AS (SELECT house_id, slice_index, {sql.SAFE_AVG} AS avg, {sql.label()} AS label FROM h)
    SELECT house_id, unnest(['House,' || string_agg(label, ',' ORDER BY label),
      house_id || ',' || string_agg(printf('%.3f', floor(avg * 1000 + 0.5) / 1000), ',' ORDER BY label), 'Count,' || count(*), 'Mean,' || printf('%.3f', avg(avg)),
      'Variance,' || printf('%.3f', var_pop(avg)), 'Standard deviation,' || printf('%.3f', stddev_pop(avg)),
      'MSE,' || printf('%.3f', avg((avg - slice_index) ** 2))]) AS line, unnest([0, 1, 2, 3, 4, 5, 6]) AS line_no FROM a GROUP BY house_id""",
)
def _(spark, sf_dir):
    from meterflow.functions.slices import safe_avg, slice_label

    house = w.rollup(device_slices(spark, sf_dir, 120, "dense"), "house")
    label = slice_label("read_date", "slice_gap", "slice_index").alias("label")
    series = house.select("house_id", safe_avg().alias("avg"), label, F.col("slice_index").cast("double").alias("forecast"))
    return exports.export_lines(series)


@query("write_comparison", COMPARISON_SQL, rounded="base_value other_value change_pct")
def _(spark, sf_dir):
    path = scratch_path(spark, "comparison")
    exports.write_comparison(compare_rows(spark, sf_dir), path)
    schema = "metric string, window string, base_value double, other_value double, change_pct double, change_text string, base_text string, other_text string"
    return spark.read.option("header", True).schema(schema).csv(path)
