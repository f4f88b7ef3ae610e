"""Named queries over the driver tables, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# Averages of 32 two-decimal values end exactly half-way between two 6-digit numbers, where the order of summation
# would decide. The same tiny shift on both sides moves the rounding boundary away from such values.
SHIFT = 1e-9


def query(name: str, sql: str | None = None, rounded: str = "") -> Callable[[Query], Query]:
    """Register a query. ``rounded`` names double columns whose last digits depend on summation order."""
    doubles = rounded.split()

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = build(spark, sf_dir)
            dates = {f.name: F.col(f.name).cast("string") for f in rows.schema if isinstance(f.dataType, T.DateType)}
            return rows.withColumns(dates | {c: F.round(F.col(c) + SHIFT, DIGITS) for c in doubles})

        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(f"round({c} + {SHIFT}, {DIGITS}) AS {c}" for c in doubles)
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if doubles else sql
        return build

    return add
