"""Reading scores, cooldowns, threshold alerts, routing, pacing and spike matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions.slices import gateway_of
from meterflow.functions.text import change_text, time_ago
from meterflow.operators import alerts as al
from meterflow.operators.anomaly import READING_ORDER, Detector, fire_alerts, score_readings, with_reason
from meterflow.operators.folds import ewma_baseline
from meterflow.operators.matching import detection_scores, match_alerts, nearest_first
from meterflow.operators.windows import multi_window
from meterflow.plans import sql
from meterflow.plans.catalog_slices import DENSE, device_slices, loads
from meterflow.plans.registry import query
from meterflow.schemas import DEVICE, SLICE

# The driver's values are far below household loads, so limits are scaled down.
DETECTOR = Detector(hard_ceiling=200.0, cooldown_ms=86_400_000)
DEVICE_LIMIT, HOUSE_LIMIT, DAY_MS = 100.0, 200.0, 86_400_000

_BASELINE = sql.baseline(0.3, sql.IDS, "loads", "value")
_SCORED = f"WITH RECURSIVE {DENSE}, {_BASELINE}, {sql.classified(200, 20, 3)}"
_SCORE_COLUMNS = "event_id, value, mean_before, var_before, seen_before"


def dense_loads(spark, sf_dir) -> DataFrame:
    return loads(spark, sf_dir, "dense")


def scored(spark, sf_dir) -> DataFrame:
    return score_readings(dense_loads(spark, sf_dir), DETECTOR)


@query(
    "ewma_baseline",
    f"WITH RECURSIVE {DENSE}, {_BASELINE} SELECT event_id, x AS value, mean_before, var_before, seen_before FROM fold",
    rounded="mean_before var_before",
)
def _(spark, sf_dir):
    rows = ewma_baseline(dense_loads(spark, sf_dir), DEVICE, READING_ORDER, DETECTOR.alpha)
    return rows.select(*_SCORE_COLUMNS.split(", "))


@query(
    "anomaly_classify",
    f"""{_SCORED} SELECT event_id, type, z_score, type <> 'NORMAL' AS anomaly,
    CASE type WHEN 'HARD_CEILING' THEN 'CRITICAL' WHEN 'Z_SCORE' THEN 'WARNING' ELSE 'NONE' END AS severity FROM scored""",
    rounded="z_score",
)
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "type", "z_score", "anomaly", "severity")


_REASON = """CASE type WHEN 'HARD_CEILING' THEN printf('reading %.0fW exceeds absolute ceiling 200W', floor(x + 0.5))
  WHEN 'Z_SCORE' THEN printf('reading %.0fW is %.1f sigma from baseline %.0fW', floor(x + 0.5), round(z_score, 1), floor(mean_before + 0.5))
  ELSE 'within baseline' END"""


@query("reason_text", f"{_SCORED} SELECT event_id, {_REASON} AS reason FROM scored WHERE type <> 'NORMAL'")
def _(spark, sf_dir):
    return with_reason(scored(spark, sf_dir).where("anomaly"), DETECTOR).select("event_id", "reason")


_FIRED = f"""{_SCORED}, odd AS MATERIALIZED (SELECT * FROM scored WHERE type <> 'NORMAL'),
{sql.cooled(sql.IDS, 'odd', 'event_ms, event_id', DAY_MS, False, 'event_id, x, type, z_score, mean_before')}"""


@query("alert_cooldown", f"{_FIRED} SELECT {sql.IDS}, event_id, event_ms, type, fired FROM cool")
def _(spark, sf_dir):
    return fire_alerts(scored(spark, sf_dir), DETECTOR).select(*DEVICE, "event_id", "event_ms", "type", "fired")


# --- slice limits ------------------------------------------------------------------------------------------------

_START = "(CAST(read_date AS DATE) - DATE '1970-01-01') * 86400000 + slice_index * slice_gap * 60000"
_OVER = f"""{DENSE}, {sql.slices([5])}, avgs AS (SELECT *, value_sum / value_count AS a FROM slices WHERE value_count > 0),
houses AS (SELECT house_id, avg(a) AS ha FROM avgs GROUP BY 1),
over_device AS MATERIALIZED (
  SELECT {sql.IDS}, read_date, slice_gap, slice_index, 1 AS type, {sql.round2('a')} AS value, CAST(100 AS DOUBLE) AS max,
         {sql.round2('ha')} AS avg, CAST({_START} AS BIGINT) AS event_ms
  FROM avgs JOIN houses USING (house_id) WHERE a > 100),
{sql.rollup('house', 'h')},
over_house AS MATERIALIZED (
  SELECT house_id, read_date, slice_gap, slice_index, 1 AS type, {sql.round2('value_sum')} AS value,
         CAST(200 AS DOUBLE) AS max, {sql.round2('value_sum')} AS avg, CAST({_START} AS BIGINT) AS event_ms
  FROM h WHERE value_count > 0 AND value_sum > 200)"""


def over_device(spark, sf_dir) -> DataFrame:
    return al.device_overload(multi_window(dense_loads(spark, sf_dir)), DEVICE_LIMIT)


def over_house(spark, sf_dir) -> DataFrame:
    return al.house_overload(multi_window(dense_loads(spark, sf_dir)), HOUSE_LIMIT)


@query("device_overload", f"WITH {_OVER} SELECT * FROM over_device")
def _(spark, sf_dir):
    return over_device(spark, sf_dir)


@query("house_overload", f"WITH {_OVER} SELECT * FROM over_house")
def _(spark, sf_dir):
    return over_house(spark, sf_dir)


@query(
    "attach_house_avg",
    f"""WITH {_OVER} SELECT {sql.IDS}, read_date, slice_index, a AS slice_avg, ha AS house_avg
    FROM avgs JOIN houses USING (house_id)""",
    rounded="slice_avg house_avg",
)
def _(spark, sf_dir):
    slices = device_slices(spark, sf_dir, 5, "dense")
    own = slices.withColumn("slice_avg", F.col("value_sum") / F.col("value_count"))
    return al.attach_house_avg(own).select(*DEVICE, "read_date", "slice_index", "slice_avg", "house_avg")


def _cool(keys: str, source: str) -> str:
    cte = sql.cooled(keys, source, "event_ms, slice_gap", DAY_MS, True, "value")
    return f"WITH RECURSIVE {_OVER}, {cte} SELECT {keys}, event_ms, value, fired FROM cool"


@query("threshold_cooldown", _cool(sql.IDS, "over_device"))
def _(spark, sf_dir):
    rows = al.threshold_cooldown(over_device(spark, sf_dir), DEVICE, DAY_MS)
    return rows.select(*DEVICE, "event_ms", "value", "fired")


@query("house_cooldown", _cool("house_id", "over_house"))
def _(spark, sf_dir):
    rows = al.threshold_cooldown(over_house(spark, sf_dir), ["house_id"], DAY_MS)
    return rows.select("house_id", "event_ms", "value", "fired")


@query(
    "notification_class",
    f"""WITH {_OVER} SELECT {sql.IDS}, read_date, slice_index,
    CAST(CASE WHEN a > 100 THEN 1 WHEN a < 5 THEN -1 WHEN a > ha THEN 0 END AS INT) AS type FROM avgs JOIN houses USING (house_id)""",
)
def _(spark, sf_dir):
    slices = device_slices(spark, sf_dir, 5, "dense")
    own = al.attach_house_avg(slices.withColumn("slice_avg", F.col("value_sum") / F.col("value_count")))
    kind = al.notification_class(F.col("slice_avg"), F.lit(5.0), F.col("house_avg"), F.lit(DEVICE_LIMIT))
    return own.select(*DEVICE, "read_date", "slice_index", kind.alias("type"))


@query(
    "topic_name",
    f"""WITH {_OVER} SELECT printf('device-%d-%d-%d-notification', house_id, household_id, plug_id) AS topic, count(*) AS n
    FROM over_device GROUP BY 1 UNION ALL SELECT printf('house-%d-notification', house_id), count(*) FROM over_house GROUP BY 1""",
)
def _(spark, sf_dir):
    device = over_device(spark, sf_dir).select(al.topic_name("device").alias("topic"))
    house = over_house(spark, sf_dir).select(al.topic_name("house").alias("topic"))
    return device.unionByName(house).groupBy("topic").agg(F.count("*").alias("n"))


@query(
    "notify_fanout",
    f"""WITH {_OVER} SELECT printf('device-%d-%d-%d-notification', house_id, household_id, plug_id) AS topic, event_ms, value
    FROM over_device UNION ALL SELECT 'iot-notification', event_ms, value FROM over_device""",
)
def _(spark, sf_dir):
    return al.notify_fanout(over_device(spark, sf_dir), "device").select("topic", "event_ms", "value")


def _json(ids: str) -> str:
    return f"""CAST(json_object('type', type, {ids}, 'value', value, 'max', max, 'avg', avg, 'windowMin', slice_gap,
    'ts', event_ms) AS VARCHAR)"""


_DEVICE_JSON = _json("'houseId', house_id, 'householdId', household_id, 'deviceId', plug_id")
_HOUSE_JSON = _json("'houseId', house_id")


@query(
    "notification_json",
    f"""WITH {_OVER} SELECT 'device' AS level, {_DEVICE_JSON} AS payload FROM over_device
    UNION ALL SELECT 'house', {_HOUSE_JSON} FROM over_house""",
)
def _(spark, sf_dir):
    device = over_device(spark, sf_dir).select(F.lit("device").alias("level"), al.notification_json("device").alias("payload"))
    house = over_house(spark, sf_dir).select(F.lit("house").alias("level"), al.notification_json("house").alias("payload"))
    return device.unionByName(house)


_MESSAGE = f"""{_FIRED}, told AS (SELECT *, {_REASON} AS reason,
    (CASE type WHEN 'HARD_CEILING' THEN '🚨 [METER-ALERT] CRITICAL' ELSE '⚠️ [METER-ALERT] WARNING' END) ||
      printf(' — House #%d / Household %d / Plug %d', house_id, household_id, plug_id) AS header,
    strftime(epoch_ms(event_ms), '%Y-%m-%d %H:%M:%S') AS told_at FROM cool WHERE fired)
  SELECT event_id, CAST(json_object('text', header, 'blocks', json_array(
    json_object('type', 'header', 'text', json_object('type', 'plain_text', 'text', header, 'emoji', true)),
    json_object('type', 'section', 'text', json_object('type', 'mrkdwn', 'text',
      printf('*Reading:* %.0f W', floor(x + 0.5)) || chr(10) || printf('*Baseline (EWMA):* %.0f W', floor(mean_before + 0.5)) || chr(10)
      || CASE type WHEN 'Z_SCORE' THEN printf('*Deviation:* %.1fσ', round(z_score, 1)) || chr(10) ELSE '' END || '*Why:* ' || reason)),
    json_object('type', 'context', 'elements', json_array(json_object('type', 'mrkdwn', 'text',
      '⏱ ' || told_at || '  |  Gateway: ' || {sql.gateway()} || '  |  Detector: ' || type))))) AS VARCHAR) AS message FROM told"""


@query("alert_message_json", _MESSAGE)
def _(spark, sf_dir):
    fired = fire_alerts(scored(spark, sf_dir), DETECTOR).where("fired")
    rows = fired.withColumn("gateway_id", gateway_of("house_id"))
    return rows.select("event_id", al.alert_message_json().alias("message"))


def _fix(x: str) -> str:
    """Two decimals with exact halves away from zero."""
    return f"printf('%.2f', CASE WHEN ({x}) * 8 = round(({x}) * 8) THEN ({x}) + sign({x}) * 1e-4 ELSE ({x}) END)"


def _change(sign: str, limit: str) -> str:
    d = f"(value - {limit})"
    return f"'{sign}' || {_fix(d)} || 'W (' || {_fix(f'{d} * 100 / {limit}')} || '%)'"


@query(
    "change_text",
    f"""WITH {DENSE} SELECT event_id, kind, CASE kind WHEN -1 THEN {_change('-', 'low')} WHEN 0 THEN {_change('+', 'usual')}
      ELSE {_change('+', 'high')} END AS change FROM (
      SELECT event_id, value, CAST(CASE WHEN value < 5 THEN -1 WHEN value > 100 THEN 1 ELSE 0 END AS INT) AS kind,
             CAST(5 AS DOUBLE) AS low, CAST(5 AS DOUBLE) AS usual, CAST(100 AS DOUBLE) AS high FROM loads)""",
)
def _(spark, sf_dir):
    kind = al.notification_class(F.col("value"), F.lit(5.0), F.lit(-1.0), F.lit(100.0))
    rows = dense_loads(spark, sf_dir).select("event_id", "value", kind.alias("kind"))
    text = change_text("kind", "value", F.lit(5.0), F.lit(5.0), F.lit(100.0))
    return rows.select("event_id", "kind", text.alias("change"))


@query(
    "time_ago",
    f"""WITH {DENSE} SELECT event_id, CASE WHEN age < 2000 THEN 'Just now'
      WHEN age < 60000 THEN (age // 1000) || ' second(s) ago' WHEN age < 3600000 THEN (age // 60000) || ' minute(s) ago'
      WHEN age < 86400000 THEN (age // 3600000) || ' hour(s) ago' ELSE (age // 86400000) || ' day(s) ago' END AS age_text
    FROM (SELECT event_id, (SELECT max(event_ms) FROM loads) - event_ms AS age FROM loads)""",
)
def _(spark, sf_dir):
    rows = dense_loads(spark, sf_dir)
    newest = rows.agg(F.max("event_ms")).scalar()
    return rows.select("event_id", time_ago("event_ms", newest).alias("age_text"))


# --- routing and pacing ------------------------------------------------------------------------------------------

_URL = "'https://alerts.example/' || s_name"
_ROUTED = f"""{DENSE}, routed AS MATERIALIZED (
  SELECT event_id, event_ms, house_id, plug_id,
         CASE WHEN s_acctbal > 5000 THEN {_URL} ELSE 'https://alerts.example/default' END AS url
  FROM loads LEFT JOIN supplier ON s_suppkey = house_id WHERE value >= 100)"""


def routed(spark, sf_dir) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    url = F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("https://alerts.example/"), "s_name")).otherwise(" ")
    routes = supplier.select(F.col("s_suppkey").cast("int").alias("house_id"), url.alias("url"))
    alerts = dense_loads(spark, sf_dir).where(F.col("value") >= 100)
    return al.route_alerts(alerts, routes, "https://alerts.example/default")


@query("route_alerts", f"WITH {_ROUTED} SELECT event_id, house_id, url, false AS dropped FROM routed")
def _(spark, sf_dir):
    return routed(spark, sf_dir).select("event_id", "house_id", "url", "dropped")


@query(
    "dispatch_schedule",
    f"""WITH {_ROUTED}, n AS (
      SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_ms, event_id) * 14400000 AS lag_ms FROM routed)
    SELECT event_id, url, event_ms, CAST(lag_ms + max(event_ms - lag_ms) OVER (PARTITION BY url ORDER BY event_ms, event_id
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS send_ms FROM n""",
)
def _(spark, sf_dir):
    return al.dispatch_schedule(routed(spark, sf_dir), 14_400_000).select("event_id", "url", "event_ms", "send_ms")


# --- labelled spikes ---------------------------------------------------------------------------------------------


def labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """High readings as labels, above-usual ones (reported 40 s later) as alerts."""
    rows = dense_loads(spark, sf_dir)
    spikes = rows.where("value >= 150").select(
        F.col("event_id").alias("spike_id"), *DEVICE, (F.col("event_ms") / 1000.0).alias("ts")
    )
    alerts = rows.where("value >= 120").select(
        F.col("event_id").alias("alert_id"), *DEVICE, (F.col("event_ms") / 1000.0 + 40).alias("ts")
    )
    return spikes, alerts


_LABELLED = f"""{DENSE}, spikes AS MATERIALIZED (SELECT event_id AS spike_id, {sql.IDS}, event_ms / 1000.0 AS ts FROM loads WHERE value >= 150),
alerts AS MATERIALIZED (SELECT event_id AS alert_id, {sql.IDS}, event_ms / 1000.0 + 40 AS ts FROM loads WHERE value >= 120)"""
TOLERANCE = 43_200.0


@query(
    "nearest_first",
    f"""WITH {_LABELLED}, near AS (
      SELECT s.spike_id, arg_min(a.ts, abs(a.ts - s.ts)) AS nearest FROM spikes s JOIN alerts a
      USING (house_id, household_id, plug_id) WHERE abs(a.ts - s.ts) <= 43200 GROUP BY 1)
    SELECT spike_id, {sql.IDS}, ts, nearest AS nearest_alert_ts FROM spikes LEFT JOIN near USING (spike_id)""",
    rounded="ts nearest_alert_ts",
)
def _(spark, sf_dir):
    return nearest_first(*labelled(spark, sf_dir), TOLERANCE)


# Serial choice in label order equals the stable matching in which every alert prefers the earlier label; the SQL text
# walks through the spikes one by one per device and keeps the list of used alerts.
_GREEDY = f"""WITH RECURSIVE {_LABELLED},
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {sql.IDS} ORDER BY spike_id) AS rn FROM spikes),
cand AS MATERIALIZED (
  SELECT n.house_id, n.household_id, n.plug_id, n.rn, n.spike_id, n.ts,
         list(a.alert_id ORDER BY abs(a.ts - n.ts), a.alert_id) FILTER (WHERE a.alert_id IS NOT NULL) AS ids
  FROM n LEFT JOIN alerts a ON a.house_id = n.house_id AND a.household_id = n.household_id AND a.plug_id = n.plug_id
    AND abs(a.ts - n.ts) <= 43200 GROUP BY ALL),
walk AS (
  SELECT house_id, household_id, plug_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS spike_id,
         CAST(NULL AS BIGINT) AS alert_id, CAST([] AS BIGINT[]) AS used FROM n WHERE rn = 1
  UNION ALL
  SELECT house_id, household_id, plug_id, rn, spike_id, alert_id,
         CASE WHEN alert_id IS NULL THEN used ELSE list_append(used, alert_id) END FROM (
    SELECT c.house_id, c.household_id, c.plug_id, c.rn, c.spike_id, w.used,
           list_filter(c.ids, lambda x: NOT list_contains(w.used, x))[1] AS alert_id
    FROM walk w JOIN cand c ON c.house_id = w.house_id AND c.household_id = w.household_id AND c.plug_id = w.plug_id
      AND c.rn = w.rn + 1)),
pairs AS MATERIALIZED (SELECT spike_id, alert_id FROM walk WHERE rn > 0),
matches AS MATERIALIZED (
  SELECT p.spike_id, a.alert_id, s.ts AS spike_ts, a.ts AS alert_ts FROM pairs p JOIN spikes s USING (spike_id)
  LEFT JOIN alerts a USING (alert_id)
  UNION ALL
  SELECT NULL, alert_id, NULL, ts FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM pairs WHERE alert_id IS NOT NULL))"""


@query("match_alerts", f"{_GREEDY} SELECT spike_id, alert_id, spike_ts, alert_ts FROM matches", rounded="spike_ts alert_ts")
def _(spark, sf_dir):
    return match_alerts(*labelled(spark, sf_dir), TOLERANCE).drop(*DEVICE)


@query(
    "detection_scores",
    f"""{_GREEDY}, c AS (
      SELECT count(*) FILTER (WHERE spike_id IS NOT NULL AND alert_id IS NOT NULL) AS tp,
             count(*) FILTER (WHERE spike_id IS NULL) AS fp, count(*) FILTER (WHERE alert_id IS NULL) AS fn,
             avg(alert_ts - spike_ts) AS mean_latency_s FROM matches),
    r AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c)
    SELECT *, 2 * precision * recall / (precision + recall) AS f1, fp / 43200.0 AS fp_per_min FROM r""",
    rounded="mean_latency_s precision recall f1 fp_per_min",
)
def _(spark, sf_dir):
    return detection_scores(match_alerts(*labelled(spark, sf_dir), TOLERANCE), 43_200.0)


# --- notification pages ------------------------------------------------------------------------------------------

NOTIFICATIONS_SQL = f"""{_OVER}, notes AS MATERIALIZED (
  SELECT 'device' AS level, house_id, household_id, plug_id, type, value, max, avg, read_date, slice_gap, slice_index,
         event_ms AS reg_ms FROM over_device
  UNION ALL
  SELECT 'house', house_id, NULL, NULL, type, value, max, avg, read_date, slice_gap, slice_index, event_ms FROM over_house)"""


def notifications(spark, sf_dir) -> DataFrame:
    device = over_device(spark, sf_dir).withColumn("level", F.lit("device"))
    house = over_house(spark, sf_dir).withColumn("level", F.lit("house"))
    columns = ["level", *DEVICE, "type", "value", "max", "avg", *SLICE]
    both = device.unionByName(house, allowMissingColumns=True)
    return both.select(*columns, F.col("event_ms").alias("reg_ms"))


