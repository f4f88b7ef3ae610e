"""Detector, routing, cooldown and payload cases with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from meterflow.operators import alerts as al
from meterflow.operators.anomaly import Detector, fire_alerts, reason_text, score_readings

DETECTOR = Detector(alpha=0.3, z_threshold=3.0, hard_ceiling=2500.0, warmup=10)
SCHEMA = "event_id long, event_ms long, value double, property int, plug_id int, household_id int, house_id int"


def readings(spark, *devices):
    """Each device is a list of values, one per second."""
    rows = [(d * 1000 + i, i * 1000, float(v), 1, d, 1, 3) for d, values in enumerate(devices) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def last_of(spark, *devices):
    scored = score_readings(readings(spark, *devices), DETECTOR, partitions=5).collect()
    return [max((r for r in scored if r.plug_id == d), key=lambda r: r.event_ms) for d in range(len(devices))]


def test_ceiling_fires_on_first_reading(spark):
    (row,) = last_of(spark, [2850])
    assert (row.anomaly, row.severity, row.type, row.z_score) == (True, "CRITICAL", "HARD_CEILING", 0.0)


def test_stable_values_are_normal(spark):
    warm = [100 + i % 2 for i in range(9)]
    stable = [100 + i % 3 for i in range(30)]
    scored = score_readings(readings(spark, warm, stable), DETECTOR)
    assert scored.where("anomaly").count() == 0 and scored.where("severity <> 'NONE'").count() == 0


def test_spike_is_a_warning(spark):
    for value in (900, 300):
        (row,) = last_of(spark, [100 + i % 2 for i in range(20)] + [value])
        assert (row.severity, row.type) == ("WARNING", "Z_SCORE") and row.z_score >= 3.0


def test_devices_are_independent(spark):
    a = [100 + i % 2 for i in range(20)] + [900]
    b = [2000 + i % 5 * 100 for i in range(20)] + [2100]
    first, second = last_of(spark, a, b)
    assert first.anomaly and not second.anomaly


def test_cooldown_boundaries(spark):
    rows = [(i, t, 3000.0, 1, 0, 0, 0) for i, t in enumerate([0, 59_999, 60_000, 119_999, 120_000])]
    fired = fire_alerts(score_readings(spark.createDataFrame(rows, SCHEMA), DETECTOR), DETECTOR)
    assert [r.event_ms for r in fired.where("fired").orderBy("event_ms").collect()] == [0, 60_000, 120_000]
    over = spark.createDataFrame(rows, SCHEMA).withColumn("slice_gap", F.lit(5))
    strict = al.threshold_cooldown(over, ["house_id"], 60_000)
    assert [r.event_ms for r in strict.where("fired").orderBy("event_ms").collect()] == [0, 119_999]


def test_reason_text(spark):
    row = spark.range(1).select(
        reason_text(F.lit("HARD_CEILING"), F.lit(2850.5), F.lit(1.0), F.lit(0.0), 2500.0).alias("a"),
        reason_text(F.lit("Z_SCORE"), F.lit(900.0), F.lit(100.4), F.lit(12.34), 2500.0).alias("b"),
        reason_text(F.lit("NORMAL"), F.lit(900.0), F.lit(100.4), F.lit(0.0), 2500.0).alias("c"),
    ).first()
    assert row.a == "reading 2851W exceeds absolute ceiling 2500W"
    assert row.b == "reading 900W is 12.3 sigma from baseline 100W"
    assert row.c == "within baseline"


def test_message_payload(spark):
    alert = spark.createDataFrame(
        [(3, 1, 2, "gw-03", 2850.0, 2780.0, 0.0, "CRITICAL", "HARD_CEILING", 'says "no"\n', 1_700_000_000_000)],
        "house_id int, household_id int, plug_id int, gateway_id string, value double, mean_before double, z_score double, "
        "severity string, type string, reason string, event_ms long",
    )
    message = json.loads(alert.select(al.alert_message_json("TAG").alias("m")).first().m)
    assert message["text"] == "🚨 [TAG] CRITICAL — House #3 / Household 1 / Plug 2"
    kinds = [b["type"] for b in message["blocks"]]
    assert kinds == ["header", "section", "context"]
    section = message["blocks"][1]["text"]["text"]
    assert "2850 W" in section and "2780 W" in section and "Deviation" not in section and 'says "no"' in section
    assert message["blocks"][0]["text"]["emoji"] is True and "emoji" not in message["blocks"][1]["text"]
    assert "gw-03" in message["blocks"][2]["elements"][0]["text"] and "2023-11-14 22:13:20" in message["blocks"][2]["elements"][0]["text"]


def test_routing(spark):
    alerts = spark.createDataFrame([(h,) for h in (0, 3, 7)], "house_id int")
    routes = spark.createDataFrame([(0, "u0"), (3, "  ")], "house_id int, url string")
    rows = {r.house_id: (r.url, r.dropped) for r in al.route_alerts(alerts, routes, "admin").collect()}
    assert rows == {0: ("u0", False), 3: ("admin", False), 7: ("admin", False)}
    rows = {r.house_id: (r.url, r.dropped) for r in al.route_alerts(alerts, routes, "").collect()}
    assert rows == {0: ("u0", False), 3: ("", True), 7: ("", True)}


def test_notification_class(spark):
    row = spark.range(1).select(
        *[al.notification_class(F.lit(v), F.lit(5.0), F.lit(50.0), F.lit(100.0)).alias(n) for n, v in [("a", 1.0), ("b", 60.0), ("c", 101.0), ("d", 20.0)]]
    ).first()
    assert tuple(row) == (-1, 0, 1, None)


@pytest.mark.parametrize("level,expected", [("device", "device-3-1-2-notification"), ("house", "house-3-notification")])
def test_topics(spark, level, expected):
    ids = spark.createDataFrame([(3, 1, 2)], "house_id int, household_id int, plug_id int")
    assert ids.select(al.topic_name(level).alias("t")).first().t == expected
