"""Alert destinations per house from a JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUTES_SCHEMA = "`default` string, routes map<string, string>"


def parse_routes(documents: DataFrame, column: str = "value") -> DataFrame:
    """One ``house_id, url`` row per house; keys that are not numbers and blank destinations are skipped.

    Keys like ``"1"`` and ``" 1 "`` mean the same house: the last one in the document counts. Of several documents that name a house, the
    one whose text sorts last counts.
    """
    entries = documents.select(column, F.posexplode(F.map_entries(F.from_json(column, ROUTES_SCHEMA)["routes"])).alias("place", "entry"))
    typed = entries.select(F.trim("entry.key").try_cast("int").alias("house_id"), F.trim("entry.value").alias("url"), F.struct(column, "place").alias("place"))
    valid = typed.where(F.col("house_id").isNotNull() & (F.col("url") != ""))
    return valid.groupBy("house_id").agg(F.max_by("url", "place").alias("url"))


def default_route(column: str = "value", fallback: str = "") -> Column:
    """The document's default, else the fallback; also for null, blank or broken documents."""
    own = F.trim(F.from_json(column, ROUTES_SCHEMA)["default"])
    return F.coalesce(F.when(own != "", own), F.lit(fallback.strip()))


def read_routes(spark: SparkSession, path: str, fallback: str = "") -> tuple[DataFrame, str]:
    """Routes and default destination of one small configuration file; a missing file leaves the fallback."""
    empty = spark.createDataFrame([], "house_id int, url string")
    try:
        document = spark.read.text(path, wholetext=True)
        default = document.select(default_route(fallback=fallback).alias("d")).first()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return empty, fallback.strip()
    return parse_routes(document), default.d if default else fallback.strip()


def has_destination(routes: DataFrame, default_url: str) -> bool:
    """False when there is nowhere to send anything."""
    return bool(default_url.strip()) or not routes.where(F.trim("url") != "").isEmpty()
