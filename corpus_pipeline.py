"""From raw documents to a training mix: every stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterflow.llm import decontaminate, lines, mixing, neardup, quality
from meterflow.llm.common import delete, own_tables
from meterflow.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, rejects go."""
    return quality.filter_quality(docs, _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and runs of lines go; a document of which no word is left goes as well. ``n_chars`` follows the text."""
    return lines.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.dedup_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with the words taken of each and where they come first."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The classifier is beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written and read again; what a stage wrote besides, and the result it read, is deleted then."""
    docs, at = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with own_tables(spark):
            left = stage(spark, docs, sf_dir)
            left.write.parquet(path)
        if at:
            delete(spark, at)
        docs, at = spark.read.schema(left.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
