"""Exact percentiles by refining histograms of order-preserving codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.session import stored

#: Bits of a code that one round looks at: a histogram has at most 65,536 rows a group.
DIGIT, ROUNDS = 16, 4
#: Values that share their digits and need no further round.
FEW = 1 << DIGIT
WHOLE = ("tinyint", "smallint", "int", "bigint")


def order_code(value: Column) -> Column:
    """A 64-bit integer for a double: smaller doubles have smaller codes, equal ones (0.0 and -0.0 as well) the same."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _digit(code: Column, level: int) -> Column:
    """The code's digit of a level, from the leading one (which has the sign) on."""
    shifted = F.shiftright(code, 64 - DIGIT * (level + 1))
    return shifted if level == 0 else shifted.bitwiseAND(F.lit((1 << DIGIT) - 1))


def _prefix(code: Column, digits: int) -> Column:
    return F.shiftright(code, 64 - DIGIT * digits) if digits else F.lit(0).cast("long")


def _holding(wanted: DataFrame, bins: DataFrame) -> DataFrame:
    """The bin of its prefix that each wanted rank lies in; ``_upto`` counts the values up to and with a bin."""
    inside = (F.col("_rest") < F.col("_upto")) & (F.col("_rest") >= F.col("_upto") - F.col("_n"))
    return wanted.join(bins, ["_group", "_prefix"]).where(inside)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, levels: list[float], partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, for groups of any size; nulls and NaN do not count.

    Equal values are counted first, with partial aggregation. While more than ``FEW`` values of a group share the digits found so far, a round counts the
    next digit of their codes and steps down to the digit in which the wanted rank lies; the few values left are then looked through in order. No
    window has more than 65,536 rows a group and wanted rank, whatever the group's size. With ``weight`` the rows are counts
    already. ``partitions`` is accepted for callers that give one; the rounds are ordinary aggregations.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    whole = dict(df.dtypes)[value] in WHOLE
    code = F.col(value).cast("long") if whole else order_code(F.col(value))
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    counted = rows.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    counts = stored(counted.select(group.alias("_group"), *keys, code.alias("_code"), F.col(value).alias("_value"), "_n"), "value-counts")
    totals = counts.groupBy("_group", *keys).agg(F.sum("_n").alias("_total"))
    exact = (F.col("_total") - 1) * F.col("_level")
    wanted = totals.withColumn("_level", F.explode(F.array(*[F.lit(float(p)) for p in levels]))).withColumn("_exact", exact)
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_exact"), F.ceil("_exact")))))
    wanted = stored(wanted.select("*", F.lit(0).cast("long").alias("_prefix"), F.col("_rank").alias("_rest")), "ranks")
    by_prefix = Window.partitionBy("_group", "_prefix")
    for level in range(ROUNDS + 1):
        held = counts.withColumn("_prefix", _prefix(F.col("_code"), level))
        if level:
            held = held.join(wanted.select("_group", "_prefix").distinct(), ["_group", "_prefix"], "left_semi")
        if level == ROUNDS or (held.groupBy("_group", "_prefix").count().agg(F.max("count")).first()[0] or 0) <= FEW:
            break
        bins = held.groupBy("_group", "_prefix", _digit(F.col("_code"), level).alias("_digit")).agg(F.sum("_n").alias("_n"))
        found = _holding(wanted, bins.withColumn("_upto", F.sum("_n").over(by_prefix.orderBy("_digit"))))
        down = F.col("_digit") if level == 0 else F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_digit"))
        rest = F.col("_rest") - F.col("_upto") + F.col("_n")
        wanted = stored(found.select(*[c for c in wanted.columns if c not in ("_prefix", "_rest")], down.alias("_prefix"), rest.alias("_rest")), "ranks")
    values = held.withColumn("_upto", F.sum("_n").over(by_prefix.orderBy("_code")))
    wanted = _holding(wanted, values.select("_group", "_prefix", "_n", "_upto", F.col("_value").alias("_low")))
    low, high = F.min(F.struct("_rank", "_low"))["_low"], F.max(F.struct("_rank", "_low"))["_low"]
    share = F.max("_exact") - F.min("_rank")
    per_level = wanted.groupBy("_group", *keys, "_level").agg((low + (high - low) * share).alias("_percentile"))
    out = [F.max(F.when(F.col("_level") == float(p), F.col("_percentile"))).alias(percentile_name(value, p)) for p in levels]
    return per_level.groupBy(*keys).agg(*out)


def percentile_name(value: str, level: float) -> str:
    return f"{value}_p{round(level * 100):d}"
