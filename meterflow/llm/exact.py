"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import lower_ascii, text_or_empty, written

#: Runs merged by one task of a round; 2 gives the plain binomial tree.
FAN_IN = 8
KEY = ["run", "text_sha256", "check", "n_bytes"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its identifier, the digest of its normalised text, and what verifies the digest."""
    text = lower_ascii(text_or_empty(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("norm")).select(
        "id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
    )


def _digit(number: Column, level: int, fan_in: int) -> Column:
    return F.pmod(F.floor(number / F.lit(fan_in**level)), F.lit(fan_in)).cast("long")


def merge_runs(rows: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN, runs: int | None = None) -> DataFrame:
    """Merge digest runs round by round; one row per text: ``text_sha256``, ``check``, ``n_bytes``, ``keep_id``, ``group_size``.

    Every partition is a run, numbered in base ``fan_in``. Round k brings together the runs that differ in digit k only, and deals what they hold by digit k
    of the digest: a group of ``fan_in`` tasks exchanges runs, each sorts its share of them, and walks through the sorted rows: neighbours of the same
    digest, of which an independent hash and the length in bytes agree as well, become one row with the smallest (or largest) identifier. After the last round a
    run's number is a range of digests, so equal texts have met. A text with any number of copies is one row per run from the first round on, and in
    the first round its copies go to as many runs as there are groups.
    """
    spark = rows.sparkSession
    wanted = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = max(1, math.ceil(math.log(max(wanted, 2), fan_in)))
    place = F.conv(F.substring("text_sha256", 1, 12), 16, 10).cast("long")
    first = F.pmod(F.spark_partition_id(), F.lit(fan_in**levels)).cast("long")
    by_id = F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last()
    same = Window.partitionBy(*KEY)
    merged = rows.select(first.alias("run"), "text_sha256", "check", "n_bytes", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    for level in range(levels):
        step = fan_in**level
        target = F.col("run") + (_digit(place, level, fan_in) - _digit(F.col("run"), level, fan_in)) * F.lit(step)
        run = merged.withColumn("run", target).repartition(wanted, "run")
        walked = run.withColumns({"_turn": F.row_number().over(same.orderBy(by_id)), "_size": F.sum("group_size").over(same)})
        merged = walked.where(F.col("_turn") == 1).select(*KEY, "keep_id", F.col("_size").alias("group_size"))
    return merged.drop("run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document, dropped ones too: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, so all empty texts are one
    group. ``kept`` marks the rows that carry the group's identifier: a document that is listed twice under one
    identifier is the same document and stays listed twice. Rows without identifier lose to those with one; a group
    in which none has one keeps all its rows and ``keep_id`` is null. An empty table gives an empty result, other columns are not read.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    groups = merge_runs(rows, keep)
    on = ["text_sha256", "check", "n_bytes"]
    return rows.join(groups, on).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
