"""Stream results equal batch results; replays, late rows and stored tables."""

import pytest
from pyspark.sql import functions as F

from meterflow.operators import windows as w
from meterflow.operators.anomaly import Detector, fire_alerts, score_readings
from meterflow.plans.catalog_slices import loads
from meterflow.schemas import DEVICE, DIRECT_WINDOWS, SLICE
from meterflow.sinks import exports, tables
from meterflow.sources.readings import stream_readings
from meterflow.streaming import anomalies, partials, publishing, refresh, tumbling

KEYS = [*DEVICE, *SLICE]


def same_slices(got, want):
    a = got.select(*KEYS, "value_count", F.round("value_sum", 6).alias("s"), "event_ts")
    b = want.select(*KEYS, "value_count", F.round("value_sum", 6).alias("s"), "event_ts")
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def landing(spark, sf_tiny, tmp_path_factory):
    """Three files; the last days are written first."""
    path = str(tmp_path_factory.mktemp("landing"))
    rows = loads(spark, sf_tiny, "dense")
    for low, high in [(21, 31), (11, 20), (1, 10)]:
        part = rows.where(F.dayofmonth(F.timestamp_millis("event_ms")).between(low, high))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, rows


def stream(spark, landing):
    path, rows = landing
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_partials_equal_batch_also_after_replay_and_compaction(spark, landing, tmp_path):
    root = str(tmp_path / "p")
    partials.start_partials(stream(spark, landing), root, f"{root}/cp", available_now=True).awaitTermination()
    want = w.multi_window(landing[1])
    assert same_slices(partials.partials_view(spark, root), want)
    # The same batch once more, as after a lost commit.
    first_file = spark.read.parquet(landing[0]).where(F.dayofmonth(F.timestamp_millis("event_ms")) >= 21)
    partials.write_partials(root)(first_file, 0)
    assert same_slices(partials.partials_view(spark, root), want)
    assert partials.compact_partials(spark, root) == 2
    assert same_slices(partials.partials_view(spark, root), want)
    extra = spark.read.parquet(landing[0]).limit(0)
    partials.write_partials(root)(extra, 3)
    assert partials.compact_partials(spark, root) == 2
    assert same_slices(partials.partials_view(spark, root), want)


def test_folding_writes_touched_days_only(spark, landing, tmp_path):
    root, rows = str(tmp_path / "p"), landing[1]
    day = F.dayofmonth(F.timestamp_millis("event_ms"))
    flush = partials.write_partials(root, [30])
    assert partials.compact_partials(spark, root) == -1
    for batch, part in enumerate([day <= 10, (day > 8) & (day <= 20), day <= 2]):
        flush(rows.where(part), batch)
        assert partials.compact_partials(spark, root) == batch
    flush(rows.where(day == 15), 3)
    folded = spark.read.parquet(f"{root}/folded").groupBy("read_date").agg(F.min("upto").alias("low"), F.max("upto").alias("high"))
    assert {r.read_date.day: (r.low, r.high) for r in folded.collect()} == {d: (2, 2) if d <= 2 else (0, 0) if d <= 8 else (1, 1) for d in range(1, 21)}
    every = rows.where(day <= 10).unionByName(rows.where((day > 8) & (day <= 20))).unionByName(rows.where(day <= 2)).unionByName(rows.where(day == 15))
    assert same_slices(partials.partials_view(spark, root), w.multi_window(every, [30]))


def test_closed_slices_leave_the_log(spark, landing, tmp_path):
    log, rows = str(tmp_path / "log"), landing[1]
    day = F.dayofmonth(F.timestamp_millis("event_ms"))
    flush = tumbling.write_flushes(log)
    for batch, part in enumerate([day <= 10, day <= 20, day <= 31]):  # totals so far, in order
        flush(w.window_slices(rows.where(part), 30), batch)
    cut = int(rows.where(day <= 15).agg(F.max("event_ms")).first()[0])
    tumbling.close_slices(spark, log, cut)
    want = w.multi_window(rows, [30])
    assert same_slices(tumbling.tumbling_view(spark, log, [30]), want)
    final = spark.read.parquet(f"{log}-final")
    assert spark.read.parquet(log).select("batch").distinct().count() == 1 and final.count() + spark.read.parquet(log).count() == want.count()
    tumbling.close_slices(spark, log, cut)  # nothing new
    flush(w.window_slices(rows.where(day == 31), 30), 3)
    tumbling.close_slices(spark, log, cut + 90 * 86_400_000)
    assert same_slices(tumbling.tumbling_view(spark, log, [30]), want) and spark.read.parquet(log).count() == 0


def test_refused_messages_wait_in_the_outbox(spark, tmp_path):
    root = str(tmp_path / "out")

    def connect():
        def send(message_id, topic, payload, attempt):
            if attempt <= int(message_id) % 3:
                raise ConnectionError("no answer")

        return send

    def rows(ids):
        return spark.createDataFrame([(str(i), "t", f'{{"text": "line\\nbreak {i}"}}') for i in ids], "message_id string, topic string, payload string")

    for flush, ids in enumerate([range(6), range(6, 9), []]):
        publishing.flush_messages(rows(ids), root, flush, connect)
        publishing.flush_messages(rows(ids), root, flush, connect)  # the same flush again, as after a lost commit
        held = {r.message_id: r.attempts for r in publishing.read_outbox(spark, root).collect()}
        assert held == [{"1": 1, "2": 1, "4": 1, "5": 1}, {"2": 2, "5": 2, "7": 1, "8": 1}, {"8": 2}][flush]
    publishing.flush_messages(rows([]), root, 3, connect)
    assert publishing.read_outbox(spark, root).count() == 0
    sent = {r.message_id: (r.attempts, r.payload) for r in publishing.delivered(spark, root).collect()}
    assert sent == {str(i): (i % 3 + 1, f'{{"text": "line\\nbreak {i}"}}') for i in range(9)} and publishing.delivered(spark, root).count() == 9


def test_moments_merge_and_come_apart(spark):
    leaves = [(1, 30, i % 2, float(v), d) for d in range(6) for i, v in enumerate([3 * d, d * d])]
    rows = spark.createDataFrame(leaves, "house_id int, slice_gap int, slice_index int, avg double, day int")
    whole = refresh.merge_moments(refresh.as_state(rows))
    parts = refresh.merge_moments(refresh.as_state(rows.where("day < 4")))
    moved = refresh.merge_moments(parts.unionByName(refresh.as_state(rows.where("day = 1"), -1)).unionByName(refresh.as_state(rows.where("day >= 4 or day = 1"))))
    figures = lambda state: {r.slice_index: (r.n, round(r.mean, 9), round(r.m2, 6)) for r in state.collect()}
    assert figures(whole) == figures(moved) == {0: (6, 7.5, 157.5), 1: (6, round(55 / 6, 9), round(979 - 55 * 55 / 6, 6))}
    gone = refresh.merge_moments(parts.unionByName(refresh.as_state(rows.where("day < 4"), -1)))
    assert gone.count() == 0


def test_tumbling_drops_only_late_rows(spark, landing, tmp_path):
    wide, narrow = str(tmp_path / "wide"), str(tmp_path / "narrow")
    query = tumbling.start_tumbling(stream(spark, landing), f"{wide}/log", f"{wide}/cp", lateness="60 days", available_now=True)
    query.awaitTermination()
    want = w.multi_window(landing[1])
    assert same_slices(tumbling.tumbling_view(spark, f"{wide}/log", DIRECT_WINDOWS), want)
    query = tumbling.start_tumbling(stream(spark, landing), f"{narrow}/log", f"{narrow}/cp", available_now=True)
    query.awaitTermination()
    kept = tumbling.tumbling_view(spark, f"{narrow}/log", [1]).agg(F.sum("value_count")).first()[0]
    assert 0 < kept < landing[1].count()


def test_stream_scores_equal_batch_in_time_order(spark, sf_tiny, tmp_path):
    rows = loads(spark, sf_tiny, "dense")
    path = str(tmp_path / "ordered")
    for low, high in [(1, 10), (11, 20), (21, 31)]:
        part = rows.where(F.dayofmonth(F.timestamp_millis("event_ms")).between(low, high))
        part.coalesce(1).write.mode("append").parquet(path)
    detector = Detector(hard_ceiling=120.0, warmup=5, cooldown_ms=86_400_000)
    root = str(tmp_path / "scores")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    anomalies.start_scores(source, detector, f"{root}/rows", f"{root}/cp", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{root}/rows")
    want = score_readings(rows, detector)
    columns = ["event_id", "type", F.round("z_score", 6).alias("z"), "seen_before"]
    assert got.select(*columns).exceptAll(want.select(*columns)).count() == 0 and got.count() == want.count()
    fired = {r.event_id for r in fire_alerts(want, detector).where("fired").collect()}
    assert {r.event_id for r in got.where("fired").collect()} == fired and fired


def test_stream_of_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("0,1377986401,120.5,1,1,0,0\nbad\n")
    rows = stream_readings(spark, str(tmp_path / "in"), max_files=1)
    query = rows.writeStream.format("memory").queryName("text_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.event_ms for r in spark.table("text_rows").collect()] == [1377986401000]


def test_slices_are_partitioned_and_days_replaced(spark, sf_tiny, tmp_path):
    path = str(tmp_path / "device")
    slices = w.multi_window(loads(spark, sf_tiny), [30, 60])
    tables.write_slices(slices, path)
    total = spark.read.parquet(path).count()
    day = slices.where(F.col("read_date") == "2024-01-05")
    tables.write_slices(day.withColumn("value_sum", F.lit(0.0)), path)
    stored = spark.read.parquet(path)
    assert stored.count() == total
    assert stored.where("value_sum = 0").count() == day.count() + slices.where("read_date <> '2024-01-05' and value_sum = 0").count()
    plan = stored.where("slice_gap = 60 and read_date = '2024-01-05'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slice_gap" in plan


def test_compact_and_init(spark, sf_tiny, tmp_path):
    log, root = w.flush_log(loads(spark, sf_tiny), 60), str(tmp_path / "db")
    assert len(tables.init_tables(spark, root)) == 6
    assert tables.init_tables(spark, root) == []
    tables.append_log(log, f"{root}/log", 0)
    tables.compact(spark, f"{root}/log", f"{root}/current")
    assert same_slices(spark.read.parquet(f"{root}/current"), w.merge_latest(log))


def test_exports(spark, tmp_path):
    series = spark.createDataFrame([(3, "b", 2.0), (3, "a", 1.0), (4, "a", 5.0)], "house_id int, label string, avg double")
    exports.export_csv(series, str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv" / "house_id=3").glob("*.txt")
    assert part.read_text().splitlines() == [
        "House,a,b", "3,1.000,2.000", "Count,2", "Mean,1.500", "Variance,0.250", "Standard deviation,0.500",
    ]
