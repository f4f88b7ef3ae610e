"""Measurement queries: load steps, rates, run statistics, outages, comparisons and self-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions.slices import epoch_seconds, gateway_of, int_div
from meterflow.functions.text import arrow_pct, format_number, parse_size, percent_change, rounded
from meterflow.operators.folds import Baseline, with_streak
from meterflow.operators.ranks import exact_percentiles
from meterflow.operators.segments import fold_segments
from meterflow.schemas import DEVICE, SLICE

MAX_LATENCY_MS = 3_600_000
IDLE_SECONDS = 15
# Two-sided 95 % critical values of Student's t for 1 to 10 degrees of freedom; beyond that 1.96.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228}
T95_LARGE = 1.96


# --- latency -----------------------------------------------------------------------------------------------------


def valid_latency(device_table: DataFrame, write_column: str = "first_written_at", gap: int | None = None) -> DataFrame:
    """Rows with a plausible delay between the freshest reading and its write."""
    latency = F.col(write_column) - F.col("event_ts")
    rows = device_table.where((F.col("event_ts") > 0) & (F.col(write_column) > 0))
    if gap is not None:
        rows = rows.where(F.col("slice_gap") == gap)
    return rows.withColumn("latency_ms", latency).where(F.col("latency_ms").between(0, MAX_LATENCY_MS))


def latency_report(device_table: DataFrame, write_column: str = "first_written_at", gap: int | None = None) -> DataFrame:
    """Count, mean, interpolated percentiles and range; of no rows the count is 0 and the rest null.

    Latencies are whole milliseconds of at most one hour, so counting each distinct value first bounds what the
    final task holds, however many rows there are.
    """
    counts = valid_latency(device_table, write_column, gap).groupBy("latency_ms").agg(F.count("*").alias("n"))
    levels = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples"),
        (F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n")).alias("mean_ms"),
        levels.alias("p"),
        F.max("latency_ms").alias("max_ms"),
        F.min("latency_ms").alias("min_ms"),
    ).select(
        "samples",
        "mean_ms",
        F.col("p")[0].alias("p50_ms"),
        F.col("p")[1].alias("p95_ms"),
        F.col("p")[2].alias("p99_ms"),
        "max_ms",
        "min_ms",
    )


# --- load steps --------------------------------------------------------------------------------------------------


def join_segments(samples: DataFrame, steps: DataFrame, skip_s: float = 0.0, bucket_s: int = 3600) -> DataFrame:
    """Samples inside the settled part of each load step, ``start + skip <= epoch <= end``.

    Each step is listed once per time bucket it touches, which makes the range join an equi-join: Catalyst may
    broadcast the steps or shuffle both sides, and never compares every sample with every step.
    """
    bounded = steps.withColumn("_from", F.col("step_start") + skip_s).where(F.col("_from") <= F.col("step_end"))
    buckets = F.explode(F.sequence(F.floor(F.col("_from") / bucket_s), F.floor(F.col("step_end") / bucket_s)))
    listed = bounded.withColumn("_bucket", buckets)
    placed = samples.withColumn("_bucket", F.floor(F.col("epoch") / bucket_s))
    joined = placed.join(listed, "_bucket").where(F.col("epoch").between(F.col("_from"), F.col("step_end")))
    return joined.drop("_bucket", "_from")


def _end(column: str, pick) -> Column:
    return pick(F.when(F.col(column).isNotNull(), F.struct("epoch", column)))


def segment_endpoints(joined: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """First and last present sample of a column."""
    return joined.groupBy(*keys).agg(
        _end(column, F.min)["epoch"].alias("first_epoch"),
        _end(column, F.min)[column].alias("first_value"),
        _end(column, F.max)["epoch"].alias("last_epoch"),
        _end(column, F.max)[column].alias("last_value"),
        F.count(column).alias("points"),
    )


def counter_rate(joined: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Growth of a running counter per second; a fall counts as zero, fewer than two points give null."""
    ends = segment_endpoints(joined, column, keys)
    seconds = F.greatest(F.col("last_epoch") - F.col("first_epoch"), F.lit(1e-9))
    growth = F.greatest(F.col("last_value") - F.col("first_value"), F.lit(0.0))
    return ends.select(*keys, F.when(F.col("points") >= 2, growth / seconds).alias("per_s"))


def wan_rate(joined: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Received bytes as kilobytes per minute."""
    ends = segment_endpoints(joined, column, keys)
    minutes = F.greatest((F.col("last_epoch") - F.col("first_epoch")) / 60.0, F.lit(1e-9))
    kilobytes = (F.col("last_value") - F.col("first_value")) / 1024.0
    return ends.select(*keys, F.when(F.col("points") >= 2, kilobytes / minutes).alias("kb_per_min"))


def segment_percentiles(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Capacity and latency percentiles per step, largest values and number of samples.

    Ranks, largest values and numbers of samples all come from counts per step, series and value.
    """
    series = ("cap", "lat", "gwcap")
    long = joined.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("sample")) for c in series])).alias("_s")
    )
    counts = long.select(*keys, "_s.*").groupBy(*keys, "series", "sample").agg(F.count("*").alias("n"))
    tops = counts.groupBy(*keys).agg(
        *[F.max(F.when(F.col("series") == c, F.col("sample"))).alias(f"{c}_max") for c in series],
        F.sum(F.when(F.col("series") == "cap", F.col("n"))).alias("n_samples"),
    )
    ranked = counts.where(F.col("series") != "gwcap")
    levels = exact_percentiles(ranked, [*keys, "series"], "sample", [0.5, 0.95], weight="n")
    wide = levels.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("series") == c, F.col(f"sample_{p}"))).alias(f"{c}_{p}")
            for c in ("cap", "lat")
            for p in ("p50", "p95")
        ]
    )
    return tops.join(wide, keys, "left")


def runs_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per load level over repeated runs: mean, population deviation and half-width of the 95 % interval."""
    table = F.create_map(*[F.lit(x) for pair in T95.items() for x in pair])

    columns = []
    for m in metrics:
        n = F.count(m)
        t = F.coalesce(F.try_element_at(table, (n - 1).cast("int")), F.lit(T95_LARGE))
        columns += [
            rounded(F.avg(m), 2).alias(f"{m}_mean"),
            F.when(n > 1, rounded(F.stddev_pop(m), 2)).otherwise(0.0).alias(f"{m}_std"),
            F.when(n > 1, rounded(t * F.stddev_samp(m) / F.sqrt(n), 2)).alias(f"{m}_ci95"),
        ]
    return runs.groupBy("houses").agg(
        F.min("msg_per_s").alias("msg_per_s"), F.count_distinct("run_id").alias("n_runs"), *columns
    )


def numeric_level_sort(levels: DataFrame, level: str = "houses") -> DataFrame:
    """Load levels kept as text, in numeric order."""
    return levels.orderBy(F.col(level).cast("double").cast("int"))


# --- counters and gateways ---------------------------------------------------------------------------------------


def rate_over_time(samples: DataFrame, column: str, window_s: int = 60, key: str = "gateway_id") -> DataFrame:
    """Growth per second of a running counter over the trailing window, per sample.

    The oldest sample of a window is the first one at or after ``epoch - window_s``. A sliding frame would walk through
    the whole window for every row; here each sample also asks from the start of its window, and one running minimum
    from late to early answers all of them. A gateway may own most samples, so its time line is cut into buckets of
    ten windows; samples of a bucket's first window are repeated at the end of the bucket before.
    """
    span = window_s * 10

    def bucket(at: Column) -> Column:
        return F.floor(at / span)

    rows = samples.where(F.col(column).isNotNull()).select(key, "epoch", F.col(column))
    own = bucket(F.col("epoch"))
    early = F.col("epoch") < own * span + window_s
    places = F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own)))
    found = rows.select(key, places.alias("_bucket"), F.col("epoch").alias("_at"), F.struct("epoch", column).alias("_sample"))
    start = F.col("epoch") - window_s
    asked = rows.select(key, bucket(start).alias("_bucket"), start.alias("_at"), "epoch", column)
    backwards = Window.partitionBy(key, "_bucket").orderBy(F.desc("_at"))
    oldest = F.min("_sample").over(backwards.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    answered = found.unionByName(asked, allowMissingColumns=True).withColumn("_oldest", oldest)
    growth = F.col(column) - F.col(f"_oldest.{column}")
    seconds = F.col("epoch") - F.col("_oldest.epoch")
    return answered.where(F.col("epoch").isNotNull()).select(
        key, "epoch", column, F.when(seconds > 0, growth / seconds).alias("rate")
    )


def gateway_totals(samples: DataFrame, column: str, key: str = "gateway_id") -> DataFrame:
    """Sum, maximum and number of samples per gateway."""
    return samples.groupBy(key).agg(
        F.sum(column).alias("total"), F.max(column).alias("highest"), F.count("*").alias("samples")
    )


def fleet_totals(totals: DataFrame) -> DataFrame:
    """The same across gateways, with the number of live ones."""
    return totals.agg(
        F.sum("total").alias("total"), F.max("highest").alias("highest"), F.count("*").alias("live_gateways")
    )


def reduction_pct(before: Column, after: Column) -> Column:
    return 100 * (1 - after / before)


def bolt_capacity(count: Column, latency_ms: Column, window_ms: Column) -> Column:
    """Share of a flush window spent working, at most one."""
    return F.when(window_ms > 0, F.least(F.lit(1.0), count * latency_ms / window_ms)).otherwise(0.0)


def latency_ema(samples: DataFrame, alpha: float, value: str = "latency_ms", partitions: int | None = None) -> DataFrame:
    """Moving average of the latency after each sample, per gateway."""
    fold = Baseline(alpha, value)
    before = fold_segments(samples, ["gateway_id"], ["event_ms", "event_id"], fold, partitions)
    first = F.col("seen_before") == 0
    after = F.col("mean_before") * (1 - alpha) + F.col(value) * alpha
    return before.withColumn("ema_ms", F.when(first, F.col(value)).otherwise(after)).drop(
        "mean_before", "var_before", "seen_before"
    )


def flush_latency(samples: DataFrame, alpha: float, flush_ms: int = 60_000, partitions: int | None = None) -> DataFrame:
    """Per gateway and flush: average at its end, largest latency since the last one, capacity."""
    last = F.max(F.struct("event_ms", "event_id", "ema_ms"))["ema_ms"]
    flushed = (
        latency_ema(samples, alpha, partitions=partitions)
        .groupBy("gateway_id", int_div("event_ms", flush_ms).alias("flush_id"))
        .agg(last.alias("ema_ms"), F.max("latency_ms").alias("max_ms"), F.count("*").alias("processed"))
    )
    return flushed.withColumn("capacity", bolt_capacity(F.col("processed"), F.col("ema_ms"), F.lit(float(flush_ms))))


def idle_intervals(activity: DataFrame, timeout_s: int = IDLE_SECONDS, key: str = "gateway_id") -> DataFrame:
    """Spans without a message for at least the timeout, per gateway.

    Inside a time cell as long as the timeout no two messages can be that far apart, so first and last message of
    each cell say everything. Cells are linked within a day; only first and last cell of each day are linked
    across days.
    """
    cell = int_div("event_ms", timeout_s * 1000)
    cells = activity.groupBy(key, cell.alias("cell")).agg(
        F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms")
    )
    daily = cells.withColumn("day", int_div("first_ms", 86_400_000))
    in_day = Window.partitionBy(key, "day").orderBy("cell")
    inner = daily.select(key, F.lag("last_ms").over(in_day).alias("idle_from"), F.col("first_ms").alias("idle_to"))
    days = daily.groupBy(key, "day").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    over_days = Window.partitionBy(key).orderBy("day")
    outer = days.select(key, F.lag("last_ms").over(over_days).alias("idle_from"), F.col("first_ms").alias("idle_to"))
    return (
        inner.unionByName(outer)
        .where(F.col("idle_to") - F.col("idle_from") >= timeout_s * 1000)
        .withColumn("idle_ms", F.col("idle_to") - F.col("idle_from"))
    )


def latest_by_name(status: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Newest status per source."""
    rest = [c for c in status.columns if c not in (name, *order)]
    newest = F.max(F.struct(*order, *rest))
    return status.groupBy(name).agg(newest.alias("s")).select(name, "s.*")


def source_totals(latest: DataFrame) -> DataFrame:
    """Sums over the newest status of every source."""
    columns = ["speed", "total", "load", "queue", "success", "fail"]
    return latest.agg(*[F.sum(c).alias(c) for c in columns], F.bool_and("connected").alias("all_connected"))


# --- queue and outage --------------------------------------------------------------------------------------------


def stable_run(samples: DataFrame, key: str, needed: int = 3, partitions: int | None = None) -> DataFrame:
    """First time per key that ``needed`` samples in a row had an empty queue and a growing counter."""
    rows = samples.select(key, "epoch", "tuples", "queue_size")
    runs = with_streak(rows, [key], ["epoch", "tuples"], "queue_size", "tuples", partitions)
    return runs.where(F.col("streak") >= needed).groupBy(key).agg(F.min("epoch").alias("stable_at"))


def outage_report(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Deepest queue, recovery time and loss of each outage.

    ``samples``: queue_size and running counters with ``link_down`` and ``link_up`` of the outage they belong to.
    Counters are compared between the first and the last sample.
    """

    def delta(column: str) -> Column:
        return F.max_by(column, "epoch") - F.min_by(column, "epoch")

    empty_again = F.when((F.col("epoch") >= F.col("link_up")) & (F.col("queue_size") == 0), F.col("epoch"))
    sums = samples.groupBy(*keys).agg(
        F.max(F.when(F.col("epoch") >= F.col("link_down"), F.col("queue_size"))).alias("max_queue"),
        (F.min(empty_again) - F.min("link_up")).alias("recovery_s"),
        delta("enqueued").alias("enqueued"),
        delta("drained").alias("drained"),
        delta("queue_size").alias("stuck"),
        delta("flush_total").alias("attempts"),
        delta("published").alias("published"),
    )
    lost = F.greatest(F.lit(0), F.col("enqueued") - F.col("drained") - F.col("stuck"))
    unsent = F.col("attempts") - F.col("published") - F.col("stuck")
    loss = F.when(F.col("enqueued") != 0, 100.0 * lost / F.col("enqueued")).when(
        F.col("attempts") != 0, 100.0 * unsent / F.col("attempts")
    )
    return sums.withColumn("loss_pct", F.round(loss, 2))


def outage_model(
    report: DataFrame, gateways: int, windows: int, flush_s: float, outage_s: float, mode: str = "floor"
) -> DataFrame:
    """Expected queue depth beside the measured one, drain rate and whether the queue can empty at all."""
    intervals = {"floor": F.floor, "ceil": F.ceil}[mode](F.lit(outage_s / flush_s))
    depth = (intervals * windows * gateways).cast("double")
    rate = F.when(F.col("recovery_s") > 0, depth / F.col("recovery_s"))
    return (
        report.withColumn("model_queue", depth)
        .withColumn("drain_per_s", rate)
        .withColumn("s_per_batch", F.col("recovery_s") / depth)
        .withColumn("converges", rate > gateways * windows / flush_s)
    )


# --- containers and comparisons ----------------------------------------------------------------------------------


GATEWAY_PREFIX = "gw-"


def container_totals(stats: DataFrame) -> DataFrame:
    """Per sample: gateway containers, total and largest CPU and memory.

    Only containers whose name starts with ``gw-`` count. Memory is in megabytes as displayed: MB and MiB are taken as they are, GB
    and GiB times 1024.
    """
    used = F.split("mem_usage", "/")[0]
    amount = F.regexp_extract(used, r"([0-9.]+)", 1).try_cast("double")
    memory = amount * F.when(used.rlike("GiB|GB"), 1024.0).otherwise(1.0)
    cpu = F.regexp_replace("cpu_perc", "%", "").try_cast("double")
    return (
        stats.where(F.col("container").startswith(GATEWAY_PREFIX))
        .select("sample", cpu.alias("cpu"), memory.alias("mem"))
        .groupBy("sample")
        .agg(
            F.count("*").alias("containers"),
            F.sum("cpu").alias("cpu_sum"),
            F.max("cpu").alias("cpu_max"),
            F.sum("mem").alias("mem_sum_mb"),
            F.max("mem").alias("mem_max_mb"),
        )
    )


def container_summary(totals: DataFrame) -> DataFrame:
    """Mean and peak over all samples."""
    return totals.agg(
        F.count("*").alias("samples"),
        F.max_by("containers", "sample").alias("gateways"),
        F.avg("cpu_max").alias("cpu_busiest_avg"),
        F.max("cpu_max").alias("cpu_busiest_peak"),
        F.avg("mem_max_mb").alias("mem_busiest_avg_mb"),
        F.max("mem_max_mb").alias("mem_busiest_peak_mb"),
        F.avg("mem_sum_mb").alias("mem_sum_avg_mb"),
        F.max("mem_sum_mb").alias("mem_sum_peak_mb"),
    )


def compare_systems(base: DataFrame, other: DataFrame) -> DataFrame:
    """Metric tables of two systems side by side, with the change in per cent and as display text."""
    keys = ["metric", "window"]
    both = base.withColumnRenamed("value", "base_value").join(other.withColumnRenamed("value", "other_value"), keys, "full")
    return both.select(
        *keys,
        "base_value",
        "other_value",
        percent_change("base_value", "other_value").alias("change_pct"),
        arrow_pct("base_value", "other_value").alias("change_text"),
        format_number("base_value").alias("base_text"),
        format_number("other_value").alias("other_text"),
    )


def wan_delta(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Received bytes between the first and the last snapshot; a single snapshot counts as itself."""
    last, first = F.max_by("rx_bytes", "taken_at"), F.min_by("rx_bytes", "taken_at")
    return (
        snapshots.where(F.col("rx_bytes").isNotNull())
        .groupBy(*keys)
        .agg(F.when(F.count("*") > 1, last - first).otherwise(last).alias("wan_bytes"))
    )


def received_bytes(net_io: Column | str) -> Column:
    """The incoming part of ``12.3MB / 4.5kB``."""
    text = F.col(net_io) if isinstance(net_io, str) else net_io
    return parse_size(F.split(text, "/")[0])


# --- self-checks -------------------------------------------------------------------------------------------------


def duplicate_check(device_table: DataFrame) -> DataFrame:
    """Rows beyond the first of each primary key, counted after grouping by the key."""
    per_key = device_table.groupBy(*DEVICE, *SLICE).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def window_check(device_table: DataFrame, expected_count: Column, expected_avg: Column, keys: list[str]) -> DataFrame:
    """Totals per window size and whether they meet the expectation."""
    sums = device_table.groupBy(*keys, "slice_gap").agg(
        F.sum("value_count").alias("count"), F.sum("value_sum").alias("sum")
    )
    average = F.when(F.col("count") > 0, rounded(F.col("sum") / F.col("count"), 2))
    good = (F.abs(F.col("avg") - expected_avg) < 0.01) & (F.abs(F.col("count") - expected_count) < 0.5)
    return sums.withColumn("avg", average).withColumn("ok", good)


def slice_gap_check(table: DataFrame, keys: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """Missing slice numbers between the smallest and the largest one present."""
    rows = table
    if first is not None:
        rows = rows.where(F.col("slice_index") >= first)
    if last is not None:
        rows = rows.where(F.col("slice_index") <= last)
    present = rows.select(*keys, "slice_index").distinct()
    missing = F.max("slice_index") - F.min("slice_index") + 1 - F.count("*")
    return present.groupBy(*keys).agg(missing.cast("long").alias("missing"))


# --- driver tables as measurement series -------------------------------------------------------------------------


def samples_from_readings(readings: DataFrame) -> DataFrame:
    """Readings seen as metric samples: values as latency and capacity, the event number as a running counter.

    Some series have gaps: latency is absent on non-load rows, gateway capacity on plug 3, traffic on plug 1.
    """
    value, counter = F.col("value"), F.col("event_id").cast("double")
    return readings.select(
        epoch_seconds("event_ms").alias("epoch"),
        gateway_of("house_id").alias("gateway_id"),
        (value / 400.0).alias("cap"),
        F.when(F.col("property") == 1, value).alias("lat"),
        counter.alias("ack"),
        counter.alias("tup"),
        F.when(F.col("plug_id") != 3, value / 500.0).alias("gwcap"),
        F.when(F.col("plug_id") != 1, counter * 512.0).alias("wan_rx"),
    )


def steps_from_readings(readings: DataFrame, length_s: int = 43_200) -> DataFrame:
    """One load step per day, starting with the day's first reading."""
    day = int_div("event_ms", 86_400_000)
    return readings.groupBy(day.alias("day")).agg(
        F.day(F.timestamp_millis(F.min("event_ms"))).alias("houses"),
        epoch_seconds(F.min("event_ms")).alias("step_start"),
        (epoch_seconds(F.min("event_ms")) + length_s).alias("step_end"),
    )


def queue_samples_from_readings(readings: DataFrame) -> DataFrame:
    """Readings seen as queue samples, one outage from 02:00 to 05:00 on every day.

    The queue holds the reading's whole watts while the link is down, a tenth of it in the hour after, else nothing.
    """
    ms_of_day = F.col("event_ms") % 86_400_000
    hour = int_div(ms_of_day, 3_600_000)
    queue = (
        F.when(hour.between(2, 4), F.floor("value")).when(hour == 5, F.floor(F.col("value") / 10)).otherwise(0).cast("long")
    )
    midnight = (F.col("event_ms") - ms_of_day) / 1000.0
    return readings.select(
        int_div("event_ms", 86_400_000).cast("int").alias("session_id"),
        "event_id",
        epoch_seconds("event_ms").alias("epoch"),
        queue.alias("queue_size"),
        F.col("event_id").alias("enqueued"),
        (F.col("event_id") - queue).alias("drained"),
        (F.col("event_id") * 2).alias("flush_total"),
        (F.col("event_id") * 2 - queue).alias("published"),
        F.col("event_id").cast("double").alias("tuples"),
        (midnight + 7_200).alias("link_down"),
        (midnight + 18_000).alias("link_up"),
    )
