"""Cooldowns by the graph of successors.

Of one key's times, the one after a fired time t is the first that is at least ``wait`` later. That successor is looked up for every time by
an as-of join on time buckets one wait wide: it lies in the next bucket, or else is the first time of the bucket after
that. If both are empty the chain ends, and a new one begins by itself, since the first time after an empty bucket always fires. So all chains
begin at known times, and pointer doubling marks what lies on them: after k rounds the pointers span 2^k steps. No step of this
gathers a key: a key with a third of all rows spreads over its buckets and times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.operators.segments import KEY, key_text
from meterflow.session import stored


def links(times: DataFrame, width: int) -> DataFrame:
    """``_key``, ``t``, ``next``, ``root``: the first time of the key at least ``width`` after t, null where the chain ends, and whether t begins one.

    ``times`` has the distinct ``_key``, ``t`` and their ``bucket`` of ``width``. The first time after an empty bucket is a root: it fires whatever
    came before, so no chain leads to it.
    """
    none = F.lit(None).cast("long")
    points = times.select(KEY, "bucket", F.col("t").alias("at"), F.col("t").alias("point"), none.alias("of"))
    probes = times.select(KEY, (F.col("bucket") + 1).alias("bucket"), (F.col("t") + width).alias("at"), none.alias("point"), F.col("t").alias("of"))
    backwards = Window.partitionBy(KEY, "bucket").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = points.union(probes).withColumn("near", F.min("point").over(backwards)).where(F.col("of").isNotNull())
    # of every bucket: its own first time, and that of the one after
    firsts = times.groupBy(KEY, "bucket").agg(F.min("t").alias("first"))
    own = firsts.select(KEY, "bucket", F.col("first").alias("here"))
    after = firsts.select(KEY, (F.col("bucket") - 1).alias("bucket"), F.col("first").alias("far"))
    # a probe of bucket b looks into b + 1; the time after that counts only if b + 1 is not empty, else it is a root
    both = found.join(own.join(after, [KEY, "bucket"], "left"), [KEY, "bucket"], "left")
    chained = both.select(KEY, F.col("of").alias("t"), F.coalesce("near", F.when(F.col("here").isNotNull(), F.col("far"))).alias("next"), (F.col("bucket") - 1).alias("bucket"))
    before = firsts.select(KEY, (F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("preceded"))
    begins = firsts.join(before, [KEY, "bucket"], "left").where(F.col("preceded").isNull()).select(KEY, F.col("first").alias("t"), F.lit(True).alias("root"))
    return chained.drop("bucket").join(begins, [KEY, "t"], "left").select(KEY, "t", "next", F.coalesce("root", F.lit(False)).alias("root"))


def on_chains(times: DataFrame, width: int) -> DataFrame:
    """``_key``, ``t`` of all times on the chains of successors from the roots."""
    linked = stored(links(times, width), "cooldown-links")
    reached = linked.where("root").select(KEY, "t")
    pointers = linked.where(F.col("next").isNotNull()).select(KEY, "t", "next")

    # one doubling a round; pointers that would lead beyond a chain's end are gone, so none is left when they span the longest chain
    while not pointers.isEmpty():
        further = pointers.select(KEY, F.col("t").alias("next"), F.col("next").alias("after"))
        reached = stored(reached.union(reached.join(pointers, [KEY, "t"]).select(KEY, F.col("next").alias("t"))), "cooldown-reached")
        pointers = stored(pointers.join(further, [KEY, "next"]).select(KEY, "t", F.col("after").alias("next")), "cooldown-pointers")
    return reached


def cooldown(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    wait_ms: int,
    strict: bool = False,
    time: str = "event_ms",
    partitions: int | None = None,
) -> DataFrame:
    """All rows with ``fired``: the first row of a key fires, then the next one at least ``wait_ms`` after the last fired one.

    With ``strict`` the distance must be larger. ``order`` must start with ``time``, whole milliseconds; of the rows of one time the first in order fires. Rows
    without a time never fire. Null keys are keys. ``partitions`` spreads the rows before they are written.
    """
    spread = df.repartition(partitions, *keys, time) if partitions else df
    rows = stored(spread.withColumns({KEY: key_text(keys), "_t": F.col(time).cast("long")}), "cooldown-rows")
    width = wait_ms + int(strict)
    if width <= 0:
        return rows.withColumn("fired", F.col("_t").isNotNull()).select(*df.columns, "fired")
    times = rows.where(F.col("_t").isNotNull()).select(KEY, F.col("_t").alias("t"), F.floor(F.col("_t") / width).alias("bucket")).distinct()
    chosen = times.select(KEY, "t") if width == 1 else on_chains(times, width)
    fired = chosen.select(KEY, F.col("t").alias("_t"), F.lit(True).alias("_on"))
    first = F.row_number().over(Window.partitionBy(KEY, "_t").orderBy(*order)) == 1
    marked = rows.withColumn("_first", first).join(fired, [KEY, "_t"], "left")
    return marked.select(*df.columns, (F.col("_first") & F.coalesce("_on", F.lit(False))).alias("fired"))
