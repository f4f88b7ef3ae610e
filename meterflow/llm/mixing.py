"""Mixing sources to target weights by weighted fair queueing.

Every document of a shuffled source gets a virtual finish time: the words its source has served so far divided by the
source's weight. Serving all queues in the order of those times gives each source its share; the queue is cut at the
total budget. No step puts a whole source, or the whole queue, into one task: running sums go over a fixed
number of buckets of the order first and inside each bucket then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import WORD, text_or_empty, unused, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix per word of the corpus.
BUDGET = 1.5
#: How often a source may be passed at most.
MAX_PASSES = 2
#: Buckets of a running sum: fixed, so that a bucket of a billion documents still fits a task.
BUCKETS = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Identifier, source, size in words, and the place of every document in the shuffle of its source."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.lit(seed)))
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(text_or_empty(text_col)).alias("size"),
        F.xxhash64(text_col).alias("check"),
        key.alias("key"),
    ).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = MAX_PASSES) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``level`` and ``target`` from the words of each source.

    The level is the virtual time at which the budget is used up when a source stops at ``passes`` times its size:
    sources that stop early leave their share to the others by weight. The rows are sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0).cast("long")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1).cast("long")
    rows = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes)
    rows = rows.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    rows = rows.withColumns(
        {
            "caps_before": F.coalesce(F.sum("cap").over(before), zero),
            "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero),
            "total": F.sum("source_size").over(every),
        }
    )
    share = (F.col("total") * F.lit(float(budget)) - F.col("caps_before")) / F.col("weight_left")
    rows = rows.withColumns({"share": share, "place": F.row_number().over(by_ratio)})
    # the first source that does not stop before the budget is used up; shares further on mean nothing
    first = F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("place", "share"))).over(every)
    rows = rows.withColumn("level", F.coalesce(first["share"], F.max("ratio").over(every)))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", "weight", "level", "total", target.alias("target"))


def fair_queue(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = MAX_PASSES) -> DataFrame:
    """Every document with its queue position: ``before``, the words its source serves ahead of it, and its source's target."""
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget, passes)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0).cast("long")).alias("bucket_start"))
    starts = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size")
    queue = rows.withColumns({"row": F.row_number().over(inside), "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return (
        queue.alias("q")
        .join(starts.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.bucket") == F.col("s.bucket")))
        .select("q.id", "q.source", "q.size", "q.check", "q.bucket", "q.row", "source_size", "weight", "level", "total", "target", (F.col("bucket_start") + F.col("upto") - F.col("size")).alias("before"))
    )


def serve(queue: DataFrame, budget: float = BUDGET, passes: int = MAX_PASSES) -> DataFrame:
    """The mix: one row per document and pass, in ``offset`` order (words of the mix ahead of it), with the words ``taken``.

    A source's queue holds its documents ``passes`` times and ends at its target; the document being served then is cut there.
    The queue of all sources is range-sorted by virtual finish time and truncated at the total budget.
    """
    goal = F.floor(F.col("target") + F.lit(0.5))
    entries = queue.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    entries = entries.withColumn("start", F.col("before") + F.col("pass") * F.col("source_size"))
    entries = entries.withColumn("take", F.least(F.col("size"), goal - F.col("start"))).where(F.col("take") > 0)
    entries = entries.withColumn("finish", (F.col("start") + F.col("take")) / F.col("weight"))
    span = F.least(F.floor(F.col("finish") / F.col("level") * BUCKETS), F.lit(BUCKETS)).cast("int")
    entries = entries.withColumn("span", span)
    sums = entries.groupBy("span").agg(F.sum("take").alias("span_size"))
    ahead = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS + 1 rows
    starts = sums.select("span", F.coalesce(F.sum("span_size").over(ahead), F.lit(0).cast("long")).alias("span_start"))
    inside = Window.partitionBy("span").orderBy("finish", F.col("source").asc_nulls_last(), "bucket", "row", "pass")
    served = entries.withColumn("upto", F.sum("take").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(starts, "span")
    served = served.withColumn("offset", F.col("span_start") + F.col("upto") - F.col("take"))
    limit = F.floor(F.col("total") * F.lit(float(budget)))
    served = served.withColumn("taken", F.least(F.col("take"), limit - F.col("offset"))).where(F.col("taken") > 0)
    return served.select("id", "source", "bucket", "row", "pass", "finish", "offset", "taken")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    passes: int = MAX_PASSES,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: ``id``, ``source``, ``check`` (hash of the text), ``size``, ``source_size``, ``target``, ``taken``, ``offset`` (of its first words in the mix).

    Null texts have no words, a null source is a source of its own and comes last; documents that are not served have
    ``taken`` 0 and no ``offset``. Repeated rows queue separately. The order depends on identifiers and the
    seed only, so reruns agree. Without any word all targets are 0; an empty table gives an empty result.
    """
    queue = written(fair_queue(written(sized(docs, id_col, text_col, source_col, seed), "sizes"), weights, budget, passes), "queue")
    served = serve(queue, budget, passes).groupBy("source", "bucket", "row").agg(F.sum("taken").alias("taken"), F.min("offset").alias("offset"))
    same = F.col("q.source").eqNullSafe(F.col("m.source")) & (F.col("q.bucket") == F.col("m.bucket")) & (F.col("q.row") == F.col("m.row"))
    return queue.alias("q").join(served.alias("m"), same, "left").select(
        "q.id", "q.source", "check", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "offset"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes words of, with ``size``, ``taken`` and ``offset``; columns of these names are replaced.

    Rows that are alike in identifier, source and text share what they take evenly, rounded down.
    """
    same = ["id", "source", "check"]
    rows = mix_sources(docs, id_col, text_col, source_col, **options).groupBy(*same)
    rows = rows.agg(F.first("size").alias("size"), F.floor(F.sum("taken") / F.count("*")).alias("taken"), F.min("offset").alias("offset"))
    base = docs.drop("size", "taken", "offset")
    names = unused([*base.columns, "size", "taken", "offset"], *same)
    rows = rows.where(F.col("taken") > 0).select(*[F.col(c).alias(n) for c, n in zip(same, names, strict=True)], "size", "taken", "offset")
    on = F.col(id_col).eqNullSafe(F.col(names[0])) & F.col(source_col).eqNullSafe(F.col(names[1])) & (F.xxhash64(text_col) == F.col(names[2]))
    return base.join(rows.hint("merge"), on).drop(*names)
