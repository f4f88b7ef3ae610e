"""Known window answers, invariants, and query API behaviour."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from meterflow.functions import slices as fs
from meterflow.functions import text as ft
from meterflow.operators import measure as m
from meterflow.operators import windows as w
from meterflow.operators.forecast import median_forecast
from meterflow.plans import api, catalog_api
from meterflow.plans.catalog_slices import loads
from meterflow.schemas import DEVICE, SLICE

READING = "event_id long, event_ms long, value double, property int, plug_id int, household_id int, house_id int"


def test_sixty_equal_readings(spark):
    rows = spark.createDataFrame([(i, 1377986401000, 100.0, 1, 0, 0, 1) for i in range(60)], READING)
    table = w.multi_window(rows)
    got = {r.slice_gap: (r.value_count, r.value_sum) for r in table.collect()}
    assert got == {g: (60, 6000.0) for g in (1, 5, 10, 15, 30)}
    assert m.duplicate_check(table).first().duplicates == 0
    checked = m.window_check(table, F.lit(60), F.lit(100.0), DEVICE)
    assert checked.where("ok").count() == 5


def test_counts_agree_over_windows_and_derivation(spark, sf_tiny):
    readings = loads(spark, sf_tiny)
    table = w.all_windows(readings)
    assert {r.n for r in table.groupBy("slice_gap").agg(F.sum("value_count").alias("n")).collect()} == {readings.count()}
    direct = w.window_slices(readings, 60).select(*DEVICE, *SLICE, "value_count")
    derived = w.derive_window(w.window_slices(readings, 30), 60).select(*DEVICE, *SLICE, "value_count")
    assert direct.exceptAll(derived).count() == 0 and derived.exceptAll(direct).count() == 0


def slice_rows(spark, rows):
    return spark.createDataFrame(rows, "house_id int, household_id int, plug_id int, read_date date, slice_gap int, slice_index int, value_count long, value_sum double, event_ts long")


DAY = dt.date(2024, 1, 1)


def test_rollup_is_a_sum_of_device_means(spark):
    rows = slice_rows(spark, [(1, 0, 0, DAY, 30, 2, 10, 1000.0, 0), (1, 0, 1, DAY, 30, 2, 1, 50.0, 0), (1, 1, 0, DAY, 30, 2, 0, 0.0, 0)])
    house = w.rollup(rows, "house").first()
    assert (house.value_count, house.value_sum) == (3, 150.0)
    assert {(r.household_id, r.value_count, r.value_sum) for r in w.rollup(rows, "household").collect()} == {(0, 2, 150.0), (1, 1, 0.0)}
    assert w.house_avg_watt(rows).first().house_avg == 75.0


def test_cumulative_merge_ignores_replays(spark):
    columns = "house_id int, household_id int, plug_id int, read_date date, slice_gap int, slice_index int, batch_id string, flush_ts long, value_count long, value_sum double, event_ts long"
    key = (1, 0, 0, DAY, 30, 2)
    log = spark.createDataFrame(
        [(*key, "c", 300, 7, 70.0, 250), (*key, "a", 100, 1, 10.0, 90), (*key, "b", 200, 3, 30.0, 260), (*key, "a", 100, 1, 10.0, 90)], columns
    )
    row = w.merge_latest(log).first()
    assert (row.value_count, row.value_sum, row.event_ts, row.first_written_at, row.updated_at) == (7, 70.0, 260, 100, 300)


def test_median_forecast(spark):
    rows = slice_rows(spark, [(1, 0, 0, DAY, 30, i, 1, v, 0) for i, v in enumerate([10.0, 20.0, 40.0, 100.0])])
    got = {r.slice_index: r.forecast_value for r in median_forecast(rows, "device").collect()}
    assert got == {0: 20.0, 1: 25.0, 2: 35.0, 3: 65.0}
    zero = slice_rows(spark, [(1, 0, 0, DAY, 30, i, 1, v, 0) for i, v in enumerate([0.0, 0.0, 5.0])])
    assert {r.slice_index: r.forecast_value for r in median_forecast(zero, "device").collect()} == {0: 0.0, 1: 0.0, 2: 5.0}


def test_scalar_functions(spark):
    row = spark.createDataFrame([(DAY, 15, 3, 7, 123)], "d date, gap int, i int, a int, b int").select(
        fs.slice_label("d", "gap", "i").alias("label"),
        fs.pad2("a").alias("a"),
        fs.pad2("b").alias("b"),
        fs.round2(F.lit(-1.005)).alias("r"),
        fs.round2(F.lit(2.675)).alias("r2"),
        ft.parse_size(F.lit("4.5kiB")).alias("kib"),
        ft.parse_size(F.lit(" 12.3MB / 4B")).alias("mb"),
        ft.parse_size(F.lit("x")).alias("none"),
        ft.arrow_pct(F.lit(100.0), F.lit(250.0)).alias("up"),
        ft.arrow_pct(F.lit(100.0), F.lit(87.7)).alias("down"),
        ft.arrow_pct(F.lit(0.0), F.lit(1.0)).alias("undefined"),
        ft.format_number(F.lit(1234567.8)).alias("big"),
        ft.format_number(F.lit(12.5)).alias("small"),
        ft.format_number(F.lit(12.0)).alias("whole"),
        ft.format_number(F.lit(None).cast("double")).alias("na"),
        ft.change_text(F.lit(1), F.lit(150.0), F.lit(1.0), F.lit(2.0), F.lit(100.0)).alias("change"),
        *[ft.time_ago(F.lit(0).cast("long"), t).alias(f"t{t}") for t in (1_999, 59_999, 61_000, 7_200_000, 90_000_000)],
    ).first()
    assert row.label == "2024/01/01 00:45->01:00"
    assert (row.a, row.b) == ("07", "23") and (row.r, row.r2) == (-1.0, 2.68)
    assert (row.kib, row.mb, row.none) == (4608.0, 12.3e6, None)
    assert (row.up, row.down, row.undefined) == ("↑ 150.00%", "↓ 12.3%", "—")
    assert (row.big, row.small, row.whole, row.na) == ("1,234,568", "12.5", "12", "NA")
    assert row.change == "+50.00W (50.00%)"
    assert tuple(row)[-5:] == ("Just now", "59 second(s) ago", "1 minute(s) ago", "2 hour(s) ago", "1 day(s) ago")


@pytest.mark.parametrize(
    "query,level",
    [
        (api.SeriesQuery(house_id=1), "house"),
        (api.SeriesQuery(house_id=1, household_id="*", device_id=3), "house"),
        (api.SeriesQuery(house_id=1, household_id=2), "household"),
        (api.SeriesQuery(house_id=1, household_id=2, device_id="*"), "household"),
        (api.SeriesQuery(house_id=1, household_id=2, device_id=0), "device"),
    ],
)
def test_level_dispatch(query, level):
    assert query.level() == level


def test_day_filter_narrows_answer_not_profile(spark):
    rows = slice_rows(spark, [(1, 0, 0, dt.date(2024, 1, d), 30, 4, 1, v, 0) for d, v in [(1, 10.0), (2, 30.0)]])
    tables = {level: w.rollup(rows, level) for level in ("device", "household", "house")}
    got = api.query_forecast(tables, api.SeriesQuery(house_id=1, year=2024, month="1", day="02")).collect()
    assert [(r.day, r.avg, r.label) for r in got] == [("02", 20.0, "2024/01/02 02:00->02:30")]


def test_page_needs_wider_ids_first(spark):
    rows = spark.createDataFrame(
        [("device", h, hh, 0, DAY, 5, i, h * 100 + i) for i, (h, hh) in enumerate([(1, 0), (1, 1), (2, 0), (2, 1)])],
        "level string, house_id int, household_id int, plug_id int, read_date date, slice_gap int, slice_index int, reg_ms long",
    )
    assert [r.slice_index for r in api.notifications_page(rows, "device", house_id=1).collect()] == [1, 0]
    assert [r.slice_index for r in api.notifications_page(rows, "device", household_id=1).collect()] == [3, 2, 1, 0]
    assert [r.slice_index for r in api.notifications_page(rows, "device", offset=1, limit=2).collect()] == [2, 1]


def test_meta_and_forecast_metadata(spark, sf_tiny):
    device = w.multi_window(loads(spark, sf_tiny, "dense"), [30, 60])
    meta = api.meta({level: w.rollup(device, level) for level in ("device", "household", "house")})
    assert [r.slice_gap for r in meta["slice_gap"].collect()] == [30, 60]
    dates = meta["house_data_topo"].where("house_id = 1").first().dates
    assert [d.text for d in dates] == sorted(d.text for d in dates) and dates[0].year == "2024"
    with pytest.raises(ValueError):
        api.forecast_metadata(device, "", 30)


def test_outage_known_answer(spark):
    rows = []
    for t, queue in [(0, 0), (100, 0), (150, 40), (390, 200), (400, 200), (450, 80), (496, 0), (600, 0)]:
        rows.append((1, t, queue, 10 + (200 if t >= 400 else 0), 5 + (200 if t >= 496 else 0), t, t, 100, 400))
    samples = spark.createDataFrame(rows, "s int, epoch long, queue_size long, enqueued long, drained long, flush_total long, published long, link_down long, link_up long")
    row = m.outage_model(m.outage_report(samples, ["s"]), 8, 5, 60, 300).first()
    assert (row.max_queue, row.recovery_s, row.loss_pct) == (200, 96, 0.0)
    assert row.model_queue == 200.0 and row.drain_per_s == pytest.approx(200 / 96) and row.converges


def test_requests_read_only_the_folders_they_ask_for(spark, sf_tiny):
    levels = catalog_api.tables(spark, sf_tiny)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for wanted in (
        api.SeriesQuery(house_id=1, year=2024, month=1, day=5, slice_gap=30),
        api.SeriesQuery(house_id=1, household_id=1, device_id=2, year=2024, month=1, day=5, slice_gap=30),
    ):
        plan = api.query_series(levels, wanted)._jdf.queryExecution().executedPlan().toString()
        (filters,) = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
        assert "slice_gap" in filters and "read_date" in filters
        assert "events" not in plan and "Exchange" not in plan and "EqualTo(house_id,1)" in plan
    week = api.query_week(levels, api.SeriesQuery(year=2024, month=1), 1)._jdf.queryExecution().executedPlan().toString()
    assert "dayofmonth(read_date" in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", week)[0]
    assert catalog_api.tables(spark, sf_tiny)["house"].inputFiles() == levels["house"].inputFiles()
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_round2_does_not_round_twice(spark):
    values = [1.00499999999, 1.005, -1.005, 2.5, 0.125, -0.125]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "x double").select(fs.round2("x").alias("v")).collect()]
    assert got == [1.0, 1.0, -1.0, 2.5, 0.13, -0.12]


def test_newest_flush_wins_as_a_whole_row(spark):
    columns = "house_id int, household_id int, plug_id int, read_date date, slice_gap int, slice_index int, batch_id string, flush_ts long, value_count long, value_sum double, event_ts long"
    day = dt.date(2024, 1, 1)
    rows = [(1, 0, 0, day, 30, 3, b, ts, n, s, 5) for b, ts, n, s in [("a", 9, 7, 1.0), ("b", 9, 3, 50.0), ("c", 8, 99, 99.0)]]
    for order in (rows, rows[::-1]):
        merged = w.merge_latest(spark.createDataFrame(order, columns)).collect()
        assert [(r.value_count, r.value_sum, r.first_written_at, r.updated_at) for r in merged] == [(3, 50.0, 8, 9)]


def test_containers_as_displayed(spark):
    stats = [(1, "gw-01", "10%", "500MB / 1GB"), (1, "gw-02", "30%", "1.5GiB / 2GiB"), (1, "db-1", "90%", "9GB / 9GB"), (2, "gw-01", "20%", "100MiB / 1GiB")]
    totals = m.container_totals(spark.createDataFrame(stats, "sample int, container string, cpu_perc string, mem_usage string"))
    first, second = totals.orderBy("sample").collect()
    assert (first.containers, first.cpu_sum, first.mem_sum_mb, first.mem_max_mb) == (2, 40.0, 2036.0, 1536.0)
    assert (second.containers, second.mem_sum_mb) == (1, 100.0)
    assert m.container_summary(totals).first().gateways == 1
