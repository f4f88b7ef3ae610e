"""Compressed message bodies: what a Python worker holds, and bodies that can't be read."""

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from meterflow.sources import batches as sb


def test_bodies_leave_the_worker_before_the_batch_is_done():
    body = gzip.compress(b"x" * (sb.OUT_SIZE // 4))
    out = list(sb.gunzip_text.func(iter([pa.array([body] * 40 + [None])])))
    assert sum(len(a) for a in out) == 41 and max(a.nbytes for a in out) < 2 * sb.OUT_SIZE
    # one body that is longer than a slice is one slice
    long = list(sb.gunzip_text.func(iter([pa.array([gzip.compress(b"x" * 3 * sb.OUT_SIZE), body])])))
    assert [len(a) for a in long] == [1, 1]


def test_long_bodies_come_back_in_their_order(spark):
    texts = spark.range(60, numPartitions=1).select("id", F.repeat(F.col("id").cast("string"), 400_000).alias("text"))
    back = texts.select("id", "text", sb.gunzip_text(sb.gzip_text("text")).alias("back"))
    assert back.agg(F.count("*"), F.count_if(F.col("text") == F.col("back"))).first() == (60, 60)


def test_a_damaged_body_becomes_null(spark):
    whole = gzip.compress(b"a reading" * 100)
    damaged = [whole, whole[:-9], whole[:12] + b"\xff\xff" + whole[14:], b"", None]
    rows = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(damaged)], "id int, payload binary")
    texts = [r.t for r in rows.select("id", sb.gunzip_text("payload").alias("t")).orderBy("id").collect()]
    assert texts[0] == "a reading" * 100 and texts[1:3] == [None, None] and texts[4] is None
