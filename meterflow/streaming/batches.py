"""Receiving gateway envelopes: replay-safe log, outbox replay and notification fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from meterflow.operators.alerts import notify_fanout
from meterflow.operators.windows import merge_latest
from meterflow.sinks.tables import append_log
from meterflow.sources.batches import explode_envelopes, known_windows_only, parse_envelopes, read_envelopes
from meterflow.streaming.partials import FLUSH_INTERVAL


def stream_envelopes(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_envelopes(reader.load(path))


def log_envelopes(log_path: str) -> Callable[[DataFrame, int], None]:
    """A replayed micro-batch overwrites its own directory; replayed envelopes lose against newer flushes."""

    def flush(envelopes: DataFrame, batch: int) -> None:
        append_log(explode_envelopes(known_windows_only(envelopes)), log_path, batch)

    return flush


def start_merge(envelopes: DataFrame, log_path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = envelopes.writeStream.foreachBatch(log_envelopes(log_path)).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": FLUSH_INTERVAL}
    return writer.trigger(**trigger).start()


def merged_view(spark: SparkSession, log_path: str) -> DataFrame:
    return merge_latest(spark.read.parquet(log_path))


def replay_outbox(spark: SparkSession, outbox_path: str, log_path: str, batch: int) -> None:
    """Add queued envelopes to the log; ``batch`` names this replay, so repeating it changes nothing.

    Use negative numbers: they cannot meet those of the running stream.
    """
    append_log(explode_envelopes(known_windows_only(read_envelopes(spark, outbox_path))), log_path, batch)


def publish_notifications(path: str, level: str) -> Callable[[DataFrame, int], None]:
    """Sink for a notification stream: topic and payload rows of one micro-batch."""

    def publish(notifications: DataFrame, batch: int) -> None:
        fanned = notify_fanout(notifications, level).select("topic", "payload")
        fanned.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return publish
