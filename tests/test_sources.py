"""Readers of files and text, with broken input."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from meterflow.operators.measure import container_summary, container_totals
from meterflow.sources import batches as sb
from meterflow.sources import measurements as sm
from meterflow.sources.readings import filter_load, filter_shard, parse_readings, read_readings
from meterflow.sources.routes import has_destination, parse_routes, read_routes


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_readings_skip_bad_lines(spark):
    raw = lines(
        spark,
        "0,1377986401,120.5,1,1,0,0",
        "1, 1377986402 , 80 , 1 , 2 , 0 , 3 ",
        "2,1377986403,80,1,2,0",
        "3,1377986404,abc,1,2,0,3",
        "4,1377986405,80,0,2,0,3",
        "x,1377986406,80,1,2,0,40,extra",
        "",
    )
    rows = parse_readings(raw).orderBy("event_ms").collect()
    assert [r.event_ms for r in rows] == [1377986401000, 1377986402000, 1377986405000, 1377986406000]
    assert rows[1].house_id == 3 and rows[1].plug_id == 2 and rows[3].event_id is None
    load = filter_load(parse_readings(raw))
    assert load.count() == 3
    assert filter_shard(load, list(range(40))).count() == 2


def test_millisecond_timestamps(spark):
    assert parse_readings(lines(spark, "0,1377986401123,1,1,1,0,0"), "ms").first().event_ms == 1377986401123


def test_read_readings_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("123,1715592259,350.5,1,2,3,0\nshort,line\n")
    row = read_readings(spark, str(tmp_path)).first()
    assert (row.value, row.plug_id, row.household_id, row.house_id) == (350.5, 2, 3, 0)


def envelope(flush, records, window=30):
    return {"gatewayId": "gw-01", "flushTimestamp": flush, "windowSizeMin": window, "deviceRecords": records}


def record(count, total, ts=5):
    return {
        "houseId": 1, "householdId": 0, "plugId": 2, "year": "2013", "month": "08", "day": "31", "sliceIndex": 44,
        "count": count, "sum": total, "eventTsMs": ts,
    }


def test_gzip_payloads(spark):
    body = gzip.compress(json.dumps(envelope(7, [record(3.0, 6.0)])).encode())
    messages = spark.createDataFrame([(bytearray(body),), (bytearray(b"junk"),), (None,)], "payload binary")
    rows = sb.explode_envelopes(sb.decode_payloads(messages)).collect()
    assert len(rows) == 1
    assert rows[0].value_count == 3 and rows[0].read_date == dt.date(2013, 8, 31) and rows[0].flush_ts == 7


def test_outbox_file_and_unknown_windows(spark, tmp_path):
    content = [json.dumps(envelope(1, [record(1, 2)])), "", "not json", json.dumps(envelope(2, [])), json.dumps(envelope(3, [record(1, 2)], 7))]
    (tmp_path / "queue.jsonl").write_text("\n".join(content) + "\n")
    envelopes = sb.read_envelopes(spark, str(tmp_path))
    assert envelopes.count() == 3
    assert sb.known_windows_only(envelopes).count() == 1


def test_envelopes_are_split_and_whole(spark):
    rows = [(p % 4, 0, p, dt.date(2024, 1, 1), 30, 3, "b", 9, 1, 1.5, 4) for p in range(1000)]
    schema = (
        "house_id int, household_id int, plug_id int, read_date date, slice_gap int, slice_index int, batch_id string, "
        "flush_ts long, value_count long, value_sum double, event_ts long"
    )
    built = sb.build_envelopes(spark.createDataFrame(rows, schema))
    sizes = sorted((r.part, r.n) for r in built.select("part", F.size("deviceRecords").alias("n")).collect())
    assert sizes == [(0, 250), (1, 250), (2, 250), (3, 250)]
    assert built.select(sb.batch_id()).distinct().count() == 4


ROUTES = {"default": "https://alerts.example/admin", "routes": {"0": "https://alerts.example/0", "3": " https://alerts.example/3 "}}


@pytest.mark.parametrize(
    "text,fallback,expected,default",
    [
        (json.dumps(ROUTES), "", {0: "https://alerts.example/0", 3: "https://alerts.example/3"}, "https://alerts.example/admin"),
        (json.dumps({"routes": {"1": "u", "x": "v", "2": "  "}}), "fb", {1: "u"}, "fb"),
        ("not json {{{", "fb", {}, "fb"),
        ("", "fb", {}, "fb"),
        ("{}", "", {}, ""),
        (json.dumps({"default": "  ", "routes": None}), "fb", {}, "fb"),
    ],
)
def test_routes(spark, tmp_path, text, fallback, expected, default):
    path = tmp_path / "routes.json"
    path.write_text(text)
    routes, found = read_routes(spark, str(path), fallback)
    assert {r.house_id: r.url for r in routes.collect()} == expected
    assert found == default
    assert has_destination(routes, found) == bool(expected or default)


def test_missing_routes_file(spark, tmp_path):
    routes, default = read_routes(spark, str(tmp_path / "absent.json"), "fb")
    assert routes.count() == 0 and default == "fb"


def test_series_and_steps(spark, tmp_path):
    series, steps = tmp_path / "ts.tsv", tmp_path / "steps.tsv"
    series.write_text("epoch\tcap\tlat\tack\ttup\tgwcap\twan_rx\n100\t0.5\tnan\t7\t8\t0.1\t1024\n101\tx\t3\t9\t\t0.2\n")
    steps.write_text("houses\tstep_start\tstep_end\n5.0\t90\t200.5\n")
    rows = sm.read_series(spark, str(series)).orderBy("epoch").collect()
    assert [tuple(r) for r in rows] == [(100.0, 0.5, None, 7.0, 8.0, 0.1, 1024.0), (101.0, None, 3.0, 9.0, None, 0.2, None)]
    assert tuple(sm.read_steps(spark, str(steps)).first()) == (5, 90.0, 200.5)


def test_alert_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "2026-06-29T08:23:01.123Z [worker-gw-01] ALERT HIGH house=1 hh=0 plug=2 z=5.1\n"
        "[worker-gw-01] ALERT HIGH house=4 hh=1 plug=0 z=5.1\n"
        "2026-06-29T08:23:01Z [worker-gw-01] flush house=1 hh=0 plug=2\n"
        "2026-06-29T08:23:02Z [worker-gw-01] ALERT without ids\n"
    )
    rows = sm.read_alert_log(spark, str(tmp_path)).orderBy("house_id").collect()
    assert [(r.house_id, r.household_id, r.plug_id) for r in rows] == [(1, 0, 2), (4, 1, 0)]
    assert rows[0].ts == pytest.approx(dt.datetime(2026, 6, 29, 8, 23, 1, 123000, dt.timezone.utc).timestamp())
    assert rows[1].ts is None


def test_ground_truth(spark, tmp_path):
    spikes = [{"ts": 10, "houseId": 1, "householdId": 0, "plugId": 2, "value": 900}, {"ts": 20, "houseId": 1, "householdId": 0, "plugId": 3, "value": 901}]
    (tmp_path / "gt.json").write_text(json.dumps({"start": 0, "end": 60, "spikes": spikes}, indent=1))
    rows = sm.read_ground_truth(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.start, r.end, r.ts, r.plug_id, r.value) for r in rows] == [(0, 60, 10, 2, 900.0), (0, 60, 20, 3, 901.0)]


def test_container_stats(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "container,cpu_perc,mem_usage,net_io,block_io\ngw-01,12.5%,100MiB / 1GiB,12.3MB / 4kB,0B / 0B\n"
        "gw-02,50%,0.5GiB / 1GiB,1kB / 4kB,0B / 0B\nTOTAL_CPU_PERCENT,62.5,,,\n"
    )
    stats = sm.read_container_stats(spark, str(tmp_path))
    assert sm.container_total(stats).first().total_cpu == 62.5
    totals = container_totals(sm.container_rows(stats).withColumn("sample", F.lit(1)))
    row = totals.first()
    assert (row.containers, row.cpu_sum, row.cpu_max, row.mem_sum_mb, row.mem_max_mb) == (2, 62.5, 50.0, 612.0, 512.0)
    assert container_summary(totals).first().cpu_busiest_peak == 50.0


def test_metric_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("metric,window,value\nacked,600,12.5\nacked,all-time,NA\n")
    rows = {r.window: r.value for r in sm.read_metric_csv(spark, str(tmp_path)).collect()}
    assert rows == {"600": 12.5, "all-time": None}


def test_component_stats(spark, tmp_path):
    doc = {"name": "t", "spouts": [{"spoutId": "s", "executors": 1, "tasks": 1, "emitted": 5, "transferred": 6}], "bolts": [{"boltId": "b", "executors": 2, "tasks": 2, "emitted": 7, "transferred": 8}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = {(r.type, r.component, r.emitted) for r in sm.read_component_stats(spark, str(tmp_path)).collect()}
    assert rows == {("spout", "s", 5), ("bolt", "b", 7)}


def test_last_route_of_a_house_counts(spark):
    document = spark.createDataFrame([('{"routes": {"1": "a", " 1 ": "b", "2": "c"}}',)], "value string")
    assert sorted(map(tuple, parse_routes(document).collect())) == [(1, "b"), (2, "c")]


def test_last_metric_and_log_order_over_many_blocks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    lines = ["metric,window,value"] + [f"m{i % 3},600,{i}" for i in range(90)]
    (tmp_path / "m" / "a.csv").write_text("\n".join(lines) + "\n")
    log = [f"2026-06-29T08:{i // 60:02d}:{i % 60:02d}.000Z [x] ALERT HIGH house={i} hh=0 plug=2 z=5.1" for i in range(400)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "1.log").write_text("\n".join(log[:150]) + "\n")
    (tmp_path / "l" / "2.log").write_text("\n".join(log[150:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        values = {r.metric: r.value for r in sm.read_metric_csv(spark, str(tmp_path / "m")).collect()}
        alerts = sm.read_alert_log(spark, str(tmp_path / "l")).orderBy("alert_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert values == {"m0": 87.0, "m1": 88.0, "m2": 89.0}
    assert [(r.alert_id, r.house_id) for r in alerts] == [(i, i) for i in range(400)]
