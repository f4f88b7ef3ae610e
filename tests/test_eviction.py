"""Slices dropped after their last update."""

import time

from pyspark.sql import functions as F

from meterflow.streaming import eviction

READING = "house_id int, household_id int, plug_id int, event_ms long, value double"
HOUR = 3_600_000


def flush(spark, root, number, now, *rows, idle_ms=10):
    eviction.flush_slices(spark.createDataFrame(list(rows), READING), root, number, 30, idle_ms, now)


def view(spark, root):
    rows = eviction.live_view(spark, root).orderBy("house_id", "slice_index").collect()
    return [(r.house_id, r.slice_index, r.value_count, r.value_sum, r.event_ts, r.openings, r.live) for r in rows]


def test_idle_slices_are_final_and_open_again(spark, tmp_path):
    root = str(tmp_path / "s")
    flush(spark, root, 0, 100, (1, 0, 0, 5, 1.5), (1, 0, 0, 7, 2.0), (2, 0, 0, HOUR, 4.0))
    flush(spark, root, 1, 109, (1, 0, 0, 6, 0.25), (None, 0, 0, 6, 9.0))  # the first slice until 119, the second until 110
    assert view(spark, root) == [(1, 0, 3, 3.75, 7, 1, True), (2, 2, 1, 4.0, HOUR, 1, True)]
    for _ in range(2):  # the second time as after a lost commit
        flush(spark, root, 2, 112)
        assert view(spark, root) == [(1, 0, 3, 3.75, 7, 1, True), (2, 2, 1, 4.0, HOUR, 1, False)]
    for _ in range(2):
        flush(spark, root, 3, 119, (1, 0, 0, 9, 1.0), (2, 0, 0, HOUR + 1, 1.0))
        assert view(spark, root) == [(1, 0, 4, 4.75, 9, 2, True), (2, 2, 2, 5.0, HOUR + 1, 2, True)]
    flush(spark, root, 4, 200)
    flush(spark, root, 5, 300)
    assert [r[-2:] for r in view(spark, root)] == [(2, False), (2, False)]
    assert spark.read.parquet(f"{root}/live/flush=5").count() == 0
    assert spark.read.parquet(f"{root}/rows").groupBy("house_id", "opening").agg(F.count_if("final").alias("n")).where("n != 1").isEmpty()


def test_the_stream_has_no_call_per_slice_and_drops_without_readings(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.range(5000).select(*[(F.col("id") % n).cast("int").alias(c) for c, n in (("house_id", 50), ("household_id", 2), ("plug_id", 4))], (F.col("id") * HOUR).alias("event_ms"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{root}-in")
    for live in (True, False):
        stream = eviction.start_live_slices(spark.readStream.schema(rows.schema).parquet(f"{root}-in"), root, f"{root}-cp", 30, 500, once=True)
        stream.awaitTermination()
        assert not stream.lastProgress["stateOperators"]
        assert eviction.live_view(spark, root).groupBy("live", "openings").count().collect() == [(live, 1, 5000)]
        time.sleep(2.5)
