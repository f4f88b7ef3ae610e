"""Column expressions and written intermediate tables shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.session import scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the contracts: anything but white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, UPPER.lower())


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that columns have already, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Rows of whole texts, or pairs of them, that a Python worker is handed at a time while a table is written.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Paths of intermediate tables, by the innermost ``own_tables`` that is open.
_OWN: list[list[str]] = []


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, kept when executors are lost."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    if _OWN:
        _OWN[-1].append(path)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that are written inside, once all that reads them has been computed."""
    _OWN.append([])
    try:
        yield
    finally:
        for path in _OWN.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def added_in_arrow(docs: DataFrame, reads: list[str], fields: list[T.StructField], compute: Callable[..., list], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) and new ones that ``compute`` makes from Arrow columns of each batch.

    New columns replace old ones of the same name. Only what is kept travels back from Python.
    """
    names = [f.name for f in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    taken = list(dict.fromkeys([*kept, *reads]))
    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(*[batch.column(taken.index(c)) for c in reads])
            yield pa.RecordBatch.from_arrays([*[batch.column(taken.index(c)) for c in kept], *made], names=[*kept, *names])

    ship_package(docs.sparkSession)
    return docs.select(*taken).mapInArrow(run, schema)
