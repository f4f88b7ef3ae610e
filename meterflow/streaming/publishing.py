"""Publication that may fail, row by row, with an outbox of what was not acknowledged.

Every flush first takes what earlier ones left in the outbox, then its own rows. Each row is attempted once a flush; acknowledged
ones are recorded as delivered, the others stay in the outbox (JSON lines) with their number of attempts. A flush that runs again reads the outbox of the
flush before it and overwrites its own folders, so nothing is lost and nothing recorded twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.session import scratch_path, ship_package

#: Identifier, topic and payload of a message, and how often it has been attempted.
_MESSAGE = "message_id string, topic string, payload string, attempts long"
_SENT = f"{_MESSAGE}, acknowledged boolean, reason string"
_LINE = "line string, flush long"

#: Sends one message, given its identifier, topic, payload and the number of this attempt; raises if it was not acknowledged.
Send = Callable[[str, str, str, int], None]


def attempted(messages: DataFrame, connect: Callable[[], Send]) -> DataFrame:
    """The messages with one more attempt each, ``acknowledged`` and the ``reason`` if not. Every task connects once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = None
        for batch in batches:
            reasons: list[str | None] = []
            send = send or connect()
            for message_id, topic, payload, tries in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    send(message_id, topic, payload, tries + 1)
                    reasons.append(None)
                except Exception as error:  # whatever the broker's client raises, the row stays in the outbox
                    reasons.append(f"{type(error).__name__}: {error}")
            columns = [*batch.columns[:3], pc.add(batch.column(3), 1), pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["message_id", "topic", "payload", "attempts", "acknowledged", "reason"])

    ship_package(messages.sparkSession)
    return messages.select("message_id", "topic", "payload", "attempts").mapInArrow(run, _SENT)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("value string, flush long").text(path).toDF("line", "flush")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], _LINE)
        raise


def read_outbox(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """What the newest flush (``before`` a number) could not publish."""
    lines = _lines(spark, f"{root}/outbox")
    if before is not None:
        lines = lines.where(F.col("flush") < before)
    newest = lines.agg(F.max("flush")).first()[0]
    rows = lines.where((F.col("flush") == F.lit(newest)) & (F.col("line") != ""))
    return rows.select(F.from_json("line", _MESSAGE).alias("m")).select("m.*")


def flush_messages(messages: DataFrame, root: str, flush: int, connect: Callable[[], Send]) -> None:
    """One flush: the outbox, then ``messages`` (``message_id``, ``topic``, ``payload``), one attempt each.

    The outcome is written before it is divided, so both parts come from the same attempts.
    """
    spark = messages.sparkSession
    waiting = read_outbox(spark, root, flush).withColumn("turn", F.lit(0))
    fresh = messages.select("message_id", "topic", "payload", F.lit(0).cast("long").alias("attempts"), F.lit(1).alias("turn"))
    ordered = waiting.unionByName(fresh).repartition("message_id").sortWithinPartitions("turn", "message_id").drop("turn")
    outcome = scratch_path(spark, "attempts")
    attempted(ordered, connect).write.parquet(outcome)
    sent = spark.read.schema(_SENT).parquet(outcome)
    sent.where("acknowledged").drop("acknowledged", "reason").write.mode("overwrite").parquet(f"{root}/delivered/flush={flush}")
    kept = sent.where("not acknowledged").select(F.to_json(F.struct("message_id", "topic", "payload", "attempts")).alias("value"))
    # a flush that leaves nothing still has a line, an empty one, which says so
    end = spark.createDataFrame([("",)], "value string")
    kept.union(end).write.mode("overwrite").text(f"{root}/outbox/flush={flush}")


def publish(root: str, connect: Callable[[], Send]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a micro-batch of messages is a flush under its own number."""

    def run(messages: DataFrame, batch: int) -> None:
        flush_messages(messages, root, batch, connect)

    return run


def delivered(spark: SparkSession, root: str) -> DataFrame:
    """Acknowledged messages with their attempts and the flush that delivered them."""
    return spark.read.schema(f"{_MESSAGE}, flush long").parquet(f"{root}/delivered")

