"""Streaming jobs run to the end of the available data, with their stored result as the answer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import slices as sl
from meterflow.operators.alerts import notification_json, topic_name
from meterflow.plans import sql
from meterflow.plans.catalog_alerts import _DEVICE_JSON, _FIRED, _OVER, _SCORED, DETECTOR, over_device
from meterflow.plans.catalog_api import _META, _META_COLUMNS
from meterflow.plans.catalog_slices import DENSE, QUALITY_SQL, WIDE, dense_log, loads
from meterflow.plans.catalog_sources import SCAN_SQL, reading_lines
from meterflow.plans.registry import query
from meterflow.schemas import DEVICE, DIRECT_WINDOWS
from meterflow.session import scratch_path
from meterflow.sinks import exports
from meterflow.sources.driver_tables import stream_driver_readings
from meterflow.sources.readings import filter_load, parse_readings
from meterflow.streaming import anomalies, batches, eviction, metrics, partials, publishing, refresh, tumbling

_DEVICE_ROW = f"{sql.IDS}, read_date, slice_gap, slice_index, value_count, value_sum, event_ts"


def stream_loads(spark, sf_dir, layout: str = "wide") -> DataFrame:
    return filter_load(stream_driver_readings(spark, sf_dir, layout))


@query("stream_readings", SCAN_SQL)
def _(spark, sf_dir):
    root = scratch_path(spark, "stream-readings")
    parsed = parse_readings(reading_lines(stream_driver_readings(spark, sf_dir)))
    writer = parsed.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parsed.schema).parquet(f"{root}/rows")


@query("stream_partials", f"WITH {WIDE}, {sql.slices(DIRECT_WINDOWS)} SELECT {_DEVICE_ROW} FROM slices", rounded="value_sum")
def stream_partials(spark, sf_dir):
    root = scratch_path(spark, "partials")
    partials.start_partials(stream_loads(spark, sf_dir), root, f"{root}/cp", available_now=True).awaitTermination()
    return partials.partials_view(spark, root)


@query("stream_tumbling", f"WITH {WIDE}, {sql.slices(DIRECT_WINDOWS)} SELECT {_DEVICE_ROW} FROM slices", rounded="value_sum")
def _(spark, sf_dir):
    root = scratch_path(spark, "tumbling")
    stream = tumbling.start_tumbling(stream_loads(spark, sf_dir), f"{root}/log", f"{root}/cp", available_now=True)
    stream.awaitTermination()
    # slices that the watermark has passed become final; the view joins them with the open ones
    tumbling.close_slices(spark, f"{root}/log", tumbling.watermark_ms(stream) or 0)
    return tumbling.tumbling_view(spark, f"{root}/log", DIRECT_WINDOWS)


def _stream_scores(spark, sf_dir) -> DataFrame:
    # Four parts of the month, one a micro-batch; the stream ends after two and is started again for the others.
    root, rows = scratch_path(spark, "scores"), loads(spark, sf_dir, "dense")
    days = F.dayofmonth(F.timestamp_millis("event_ms"))
    for run in range(2):
        for part in (2 * run, 2 * run + 1):
            chunk = rows.where(F.floor((days - 1) * FILES / 31) == part)
            chunk.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        anomalies.start_scores(stream, DETECTOR, f"{root}/rows", f"{root}/cp", available_now=True).awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query("stream_anomaly", f"{_SCORED} SELECT event_id, type, z_score, mean_before, seen_before FROM scored", rounded="z_score mean_before")
def _(spark, sf_dir):
    return _stream_scores(spark, sf_dir).select("event_id", "type", "z_score", "mean_before", "seen_before")


@query("stream_cooldown", f"{_FIRED} SELECT event_id, event_ms, type, fired FROM cool")
def _(spark, sf_dir):
    return _stream_scores(spark, sf_dir).where("anomaly").select("event_id", "event_ms", "type", "fired")


_VIEW = f"""WITH {DENSE}, {sql.flushes(30)}, {sql.device_view()}
  SELECT {sql.IDS}, read_date, slice_gap, slice_index, value_count, value_sum, event_ts, first_written_at, updated_at FROM device"""


def _envelope_files(spark, sf_dir) -> str:
    path = scratch_path(spark, "incoming")
    exports.write_batches(dense_log(spark, sf_dir, 30), path)
    return path


@query("idempotent_merge", _VIEW, rounded="value_sum")
def _(spark, sf_dir):
    incoming, root = _envelope_files(spark, sf_dir), scratch_path(spark, "merge")
    for run in ("first", "second"):
        # The second run receives everything again under its own batch numbers, like a redelivery.
        stream = batches.stream_envelopes(spark, incoming, max_files=4)
        batches.start_merge(stream, f"{root}/log/run={run}", f"{root}/cp-{run}", available_now=True).awaitTermination()
    return batches.merged_view(spark, f"{root}/log")


@query("store_and_forward", _VIEW, rounded="value_sum")
def _(spark, sf_dir):
    # The first half of the month was queued during an outage and is replayed after the live half has arrived.
    log, root = dense_log(spark, sf_dir, 30), scratch_path(spark, "outbox")
    cut = F.lit("2024-01-16").cast("date")
    exports.write_batches(log.where(F.col("read_date") < cut), f"{root}/queued")
    exports.write_batches(log.where(F.col("read_date") >= cut), f"{root}/live")
    stream = batches.stream_envelopes(spark, f"{root}/live")
    batches.start_merge(stream, f"{root}/log", f"{root}/cp", available_now=True).awaitTermination()
    for _ in range(2):
        batches.replay_outbox(spark, f"{root}/queued", f"{root}/log", -1)
    return batches.merged_view(spark, f"{root}/log")


@query(
    "stream_notifications",
    f"""WITH {_OVER} SELECT printf('device-%d-%d-%d-notification', house_id, household_id, plug_id) AS topic, count(*) AS n
    FROM over_device GROUP BY 1 UNION ALL SELECT 'iot-notification', count(*) FROM over_device""",
)
def _(spark, sf_dir):
    root = scratch_path(spark, "notifications")
    over_device(spark, sf_dir).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    writer = stream.writeStream.foreachBatch(batches.publish_notifications(f"{root}/out", "device"))
    writer.option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("topic").agg(F.count("*").alias("n"))


@query(
    "stream_payloads",
    f"""WITH {_OVER} SELECT printf('device-%d-%d-%d-notification', house_id, household_id, plug_id) AS topic, {_DEVICE_JSON} AS payload
    FROM over_device UNION ALL SELECT 'iot-notification', {_DEVICE_JSON} FROM over_device""",
)
def _(spark, sf_dir):
    root = scratch_path(spark, "payloads")
    over_device(spark, sf_dir).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    writer = stream.writeStream.foreachBatch(batches.publish_notifications(f"{root}/out", "device"))
    writer.option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("topic", "payload")


@query(
    "stream_metrics",
    f"WITH {WIDE} SELECT count(*) AS received, count(*) FILTER (WHERE property = 1 AND house_id < 20) AS emitted FROM readings",
)
def _(spark, sf_dir):
    root = scratch_path(spark, "metrics")
    log = metrics.ProgressTable(spark, f"{root}/progress")
    spark.streams.addListener(log)
    try:
        rows = metrics.observed(stream_driver_readings(spark, sf_dir), list(range(20)))
        writer = rows.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/cp")
        stream = writer.trigger(availableNow=True).start()
        stream.awaitTermination()
        log.wait_for(str(stream.id))
    finally:
        spark.streams.removeListener(log)
    progress = metrics.read_progress(spark, f"{root}/progress")
    return progress.agg(F.sum("received").alias("received"), F.sum("emitted").alias("emitted"))


# --- flush cycle, late data, rate limit --------------------------------------------------------------------------

FILES = 4
_THIRTY = f"WITH {WIDE}, {sql.slices([30])} SELECT {_DEVICE_ROW} FROM slices"


def _landing(spark, sf_dir, layout: str = "wide") -> tuple[str, DataFrame]:
    """Readings of the month in several files, the latest days written first."""
    path, rows = scratch_path(spark, "landing"), loads(spark, sf_dir, layout)
    days = F.dayofmonth(F.timestamp_millis("event_ms"))
    for part in reversed(range(FILES)):
        chunk = rows.where(F.floor((days - 1) * FILES / 31) == part)
        chunk.coalesce(1).write.mode("append").parquet(path)
    return path, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("flush_trigger", _THIRTY, rounded="value_sum")
def _(spark, sf_dir):
    root = scratch_path(spark, "flush")
    stream = partials.start_partials(stream_loads(spark, sf_dir), root, f"{root}/cp", [30], interval="1 second")
    stream.processAllAvailable()
    stream.stop()
    return partials.partials_view(spark, root)


@query("late_data", _THIRTY, rounded="value_sum")
def _(spark, sf_dir):
    # Days arrive in the wrong order, one file per micro-batch, and are all counted.
    root, (_, stream) = scratch_path(spark, "late"), _landing(spark, sf_dir)
    partials.start_partials(stream, root, f"{root}/cp", [30], available_now=True).awaitTermination()
    partials.compact_partials(spark, root)
    return partials.partials_view(spark, root)


@query("cumulative_flush", _THIRTY, rounded="value_sum")
def _(spark, sf_dir):
    # Every trigger emits changed slices with their totals so far; the newest value per slice is the answer.
    root, (_, stream) = scratch_path(spark, "cumulative"), _landing(spark, sf_dir)
    flushes = tumbling.start_tumbling(stream, f"{root}/log", f"{root}/cp", base=30, lateness="60 days", available_now=True)
    flushes.awaitTermination()
    return tumbling.tumbling_view(spark, f"{root}/log", [30])


IDLE_MS = 1_000
_OPENINGS = f"""WITH {WIDE}, parts AS (SELECT *, strftime(epoch_ms(event_ms), '%Y-%m-%d') AS read_date, 30 AS slice_gap,
  CAST(event_ms % 86400000 // 1800000 AS INT) AS slice_index, day(epoch_ms(event_ms)) AS d, event_ms % 1800000 >= 900000 AS second FROM loads)
SELECT {sql.IDS}, read_date, slice_gap, slice_index, count(*) AS value_count, sum(value) AS value_sum, max(event_ms) AS event_ts,
  count(DISTINCT d > 15 AND second) AS openings, bool_or(d > 15 AND second) AS live FROM parts GROUP BY {sql.IDS}, read_date, slice_gap, slice_index"""


@query("evicted_slices", _OPENINGS, rounded="value_sum")
def _(spark, sf_dir):
    # What comes first is idle long enough to be dropped before the rest (second half-slices of later days) arrives and opens some slices again.
    root, rows = scratch_path(spark, "eviction"), loads(spark, sf_dir)
    later = (F.dayofmonth(F.timestamp_millis("event_ms")) > 15) & (F.col("event_ms") % 1_800_000 >= 900_000)
    for part, idle_ms in ((~later, IDLE_MS), (later, eviction.IDLE_MS)):
        time.sleep(IDLE_MS / 1000 + 0.5)
        rows.where(part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        eviction.start_live_slices(stream, f"{root}/slices", f"{root}/cp", 30, idle_ms, once=True).awaitTermination()
    view = eviction.live_view(spark, f"{root}/slices")
    return view.select(*DEVICE, F.date_format("read_date", "yyyy-MM-dd").alias("read_date"), "slice_gap", "slice_index", "value_count", "value_sum", "event_ts", "openings", "live")


def _refusing(refused: int) -> publishing.Send:
    """A broker that takes the messages of plug p at their attempt 1 + p % ``refused`` at the earliest."""

    def send(message_id: str, topic: str, payload: str, attempt: int) -> None:
        if attempt <= int(message_id.split("-")[2]) % refused:
            raise ConnectionError(f"{topic} does not answer")

    return send


@query(
    "publish_outbox",
    f"""WITH {_OVER} SELECT printf('%d-%d-%d-%d', house_id, household_id, plug_id, event_ms) AS message_id, CAST(1 + plug_id % 3 AS BIGINT) AS attempts,
    CAST(1 AS BIGINT) AS deliveries FROM over_device""",
)
def _(spark, sf_dir):
    # Some messages are refused once or twice; what waits in the outbox goes first in the next flush, until nothing is left.
    root, rows = scratch_path(spark, "publishing"), over_device(spark, sf_dir)
    message_id = F.format_string("%d-%d-%d-%d", *DEVICE, "event_ms")
    messages = rows.select(message_id.alias("message_id"), topic_name("device").alias("topic"), notification_json("device").alias("payload"), "read_date")
    messages.hint("rebalance", "read_date").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    connect = lambda: _refusing(3)
    writer = stream.writeStream.foreachBatch(publishing.publish(root, connect)).option("checkpointLocation", f"{root}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    none, flush = messages.drop("read_date").limit(0), 1_000_000
    while not publishing.read_outbox(spark, root).isEmpty():
        publishing.flush_messages(none, root, flush, connect)
        flush += 1
    sent = publishing.delivered(spark, root)
    return sent.groupBy("message_id").agg(F.max("attempts").alias("attempts"), F.count("*").alias("deliveries"))


@query("backpressure", f"WITH {WIDE} SELECT true AS several_batches, count(*) AS readings FROM loads")
def _(spark, sf_dir):
    # One file per micro-batch; the rest waits at the source and nothing is dropped.
    root, (_, stream) = scratch_path(spark, "limited"), _landing(spark, sf_dir)
    partials.start_partials(stream, root, f"{root}/cp", [30], available_now=True).awaitTermination()
    written = spark.read.parquet(f"{root}/batches")
    return written.agg((F.min("batch") < F.max("batch")).alias("several_batches"), F.sum("value_count").alias("readings"))


# --- refreshed views ---------------------------------------------------------------------------------------------


@query("refresh_meta", _META)
def _(spark, sf_dir):
    # Four micro-batches; each adds the entities and days that none before it had.
    root, (_, stream) = scratch_path(spark, "refresh-meta"), _landing(spark, sf_dir, "dense")
    new = refresh.entity_days(stream).writeStream.outputMode("append").format("parquet").option("path", f"{root}/days")
    new.option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    days = spark.read.parquet(f"{root}/days")
    parts = [sl.year_of("read_date").alias("year"), sl.month_of("read_date").alias("month"), sl.day_of("read_date").alias("day"), sl.date_text("read_date").alias("text")]
    return days.select("level", *DEVICE, *parts).select(*_META_COLUMNS)


@query("refresh_quality", QUALITY_SQL, rounded="mean variance standard_deviation mse")
def _(spark, sf_dir):
    # Four micro-batches; each reads the days that it changed and the state that the one before it left.
    root, (_, stream) = scratch_path(spark, "refresh-quality"), _landing(spark, sf_dir, "dense")
    writer = stream.writeStream.foreachBatch(refresh.write_and_refresh(root, [*DIRECT_WINDOWS, 60, 120]))
    writer.option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return refresh.quality_of(refresh.newest_state(spark, f"{root}/quality"))


