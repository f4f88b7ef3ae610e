"""Scoring of alerts against labelled spikes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.operators.folds import Cover, RowNumber
from meterflow.operators.segments import fold_segments
from meterflow.schemas import DEVICE
from meterflow.session import scratch_path, ship_package


def nearest_first(spikes: DataFrame, alerts: DataFrame, tolerance_s: float) -> DataFrame:
    """Each spike with the time of the closest alert of its device, if within the tolerance.

    No pairs are formed. Time is cut into buckets one tolerance wide, so the closest alert on either side lies in
    the spike's own bucket or the one next to it: inside a bucket a window finds it, and each neighbour bucket is
    reduced to its last or first alert beforehand. Ties go to the earlier alert.
    """
    bucket = F.floor(F.col("ts") / tolerance_s).alias("bucket")
    timed = alerts.where(F.col("ts").isNotNull()).select(*DEVICE, "ts", bucket)
    edges = timed.groupBy(*DEVICE, "bucket").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    spots = spikes.select("spike_id", *DEVICE, "ts", bucket)
    points = spots.select(*DEVICE, "bucket", "ts", "spike_id", F.lit(None).cast("double").alias("alert_ts")).unionByName(
        timed.select(*DEVICE, "bucket", "ts", F.lit(None).cast("long").alias("spike_id"), F.col("ts").alias("alert_ts"))
    )
    # Both are running aggregates; a frame open to the end would be started anew for every row.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    forwards = Window.partitionBy(*DEVICE, "bucket").orderBy("ts").rangeBetween(*so_far)
    backwards = Window.partitionBy(*DEVICE, "bucket").orderBy(F.desc("ts")).rangeBetween(*so_far)
    inside = points.select(
        "*", F.max("alert_ts").over(forwards).alias("before"), F.min("alert_ts").over(backwards).alias("after")
    ).where(F.col("spike_id").isNotNull())
    earlier = edges.select(*DEVICE, (F.col("bucket") + 1).alias("bucket"), F.col("last").alias("_before"))
    later = edges.select(*DEVICE, (F.col("bucket") - 1).alias("bucket"), F.col("first").alias("_after"))
    keys = [*DEVICE, "bucket"]
    around = inside.join(earlier, keys, "left").join(later, keys, "left")
    before = F.greatest("before", "_before")
    after = F.least("after", "_after")
    back = F.when(F.col("ts") - before <= tolerance_s, F.col("ts") - before)
    ahead = F.when(after - F.col("ts") <= tolerance_s, after - F.col("ts"))
    nearest = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), before).when(ahead.isNotNull(), after)
    return around.select("spike_id", *DEVICE, "ts", nearest.alias("nearest_alert_ts"))


#: A round that settles less than this part of the spikes is the last before pieces are tried again.
FEW = 8
#: So many spikes in all may be matched without cutting clusters, whose length does not matter then.
SMALL, WHOLE_S = 256, 1e15
_MATCH = "spike_id long, alert_id long, spike_ts double, alert_ts double, core boolean, band boolean"


def _free_at(link: list[int], i: int) -> int:
    """Nearest free position from ``i`` onwards in the direction of the links, halving paths on the way."""
    while link[i] != i:
        link[i] = link[link[i]]
        i = link[i]
    return i


def _greedy(tolerance_s: float):
    """Spikes of one piece of a cluster in label order, each taking the closest unused alert."""

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        spikes = rows[rows["alert_id"].isna()].sort_values("spike_id")
        alerts = rows[rows["alert_id"].notna()].sort_values(["ts", "alert_id"])
        times, ids = alerts["ts"].to_numpy(float), alerts["alert_id"].to_numpy()
        count = len(ids)
        # Sentinels at both ends: 0 on the left and count + 1 on the right; alert i sits at place i + 1.
        right, left = list(range(count + 2)), list(range(count + 2))
        run_start = np.searchsorted(times, times, side="left")
        places = np.searchsorted(times, spikes["ts"].to_numpy(float), side="left")
        out = []
        for spike_id, ts, place, core, band in zip(spikes["spike_id"], spikes["ts"], places, spikes["core"], spikes["band"]):
            options = []
            after = _free_at(right, int(place) + 1)
            if after <= count:
                options.append((times[after - 1] - ts, ids[after - 1], after))
            before = _free_at(left, int(place))
            if before >= 1:
                before = _free_at(right, int(run_start[before - 1]) + 1)
                options.append((ts - times[before - 1], ids[before - 1], before))
            options = [o for o in options if o[0] <= tolerance_s]
            if not options:
                out.append((int(spike_id), None, ts, None, core, band))
                continue
            _, alert_id, chosen = min(options)
            right[chosen], left[chosen] = chosen + 1, chosen - 1
            out.append((int(spike_id), int(alert_id), ts, float(times[chosen - 1]), core, band))
        own = alerts["core"].to_numpy()
        for i in range(count):
            if own[i] and right[i + 1] == i + 1:
                out.append((None, int(ids[i]), None, float(times[i]), True, False))
        frame = pd.DataFrame(out, columns=["spike_id", "alert_id", "spike_ts", "alert_ts", "core", "band"])
        return frame.astype({"spike_id": "Int64", "alert_id": "Int64", "spike_ts": "Float64", "alert_ts": "Float64"})

    return match


def _numbered(df: DataFrame, order: str, partitions: int | None) -> DataFrame:
    return fold_segments(df.withColumn("_one", F.lit(0.0)), DEVICE, [order], RowNumber("_one"), partitions).drop("_one")


def _pieces(clustered: DataFrame, length_s: float, halo_s: float, tolerance_s: float) -> DataFrame:
    """Clusters cut into pieces of ``length_s``, each with the points up to ``halo_s`` around it.

    ``core`` marks a piece's own points, ``band`` the borrowed ones its own spikes can compete with.
    """
    offset = F.col("ts") - F.col("cluster")
    own = F.floor(offset / length_s)
    homes = F.array(
        own,
        F.when((own > 0) & (offset - own * length_s <= halo_s), own - 1),
        F.when((own + 1) * length_s - offset <= halo_s, own + 1),
    )
    placed = clustered.withColumn("piece", F.explode(F.filter(homes, lambda p: p.isNotNull())))
    start, end = F.col("piece") * length_s, (F.col("piece") + 1) * length_s
    away = F.greatest(start - offset, offset - end)
    core = F.col("piece") == own
    return placed.withColumn("core", core).withColumn("band", ~core & (away <= 2 * tolerance_s))


def _stored(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def nearest_free(spikes: DataFrame, alerts: DataFrame, tolerance_s: float) -> DataFrame:
    """Each spike with ``alert_id``, ``alert_ts`` of the closest alert of its device within the tolerance; of equally close ones the first in the log.

    As in ``nearest_first`` no pairs are formed: windows look inside a bucket, and the last or first alert of a neighbour bucket is joined.
    """
    bucket = F.floor(F.col("ts") / tolerance_s).alias("bucket")
    late, early = F.struct("ts", (-F.col("alert_id")).alias("id")), F.struct("ts", F.col("alert_id").alias("id"))
    edges = alerts.select(*DEVICE, "ts", "alert_id", bucket).groupBy(*DEVICE, "bucket").agg(F.min(early).alias("head"), F.max(late).alias("tail"))
    none = F.lit(None).cast("long")
    points = spikes.select(*DEVICE, bucket, "ts", "spike_id", none.alias("alert_id")).unionByName(
        alerts.select(*DEVICE, bucket, "ts", none.alias("spike_id"), "alert_id")
    )
    so_far = (Window.unboundedPreceding, Window.currentRow)
    is_alert = F.col("alert_id").isNotNull()
    forwards = Window.partitionBy(*DEVICE, "bucket").orderBy("ts").rangeBetween(*so_far)
    backwards = Window.partitionBy(*DEVICE, "bucket").orderBy(F.desc("ts")).rangeBetween(*so_far)
    inside = points.select(
        "*", F.max(F.when(is_alert, late)).over(forwards).alias("before"), F.min(F.when(is_alert, early)).over(backwards).alias("after")
    ).where(F.col("spike_id").isNotNull())
    keys = [*DEVICE, "bucket"]
    earlier = edges.select(*DEVICE, (F.col("bucket") + 1).alias("bucket"), F.col("tail").alias("_before"))
    later = edges.select(*DEVICE, (F.col("bucket") - 1).alias("bucket"), F.col("head").alias("_after"))
    around = inside.join(earlier, keys, "left").join(later, keys, "left")
    before, after = F.coalesce("before", "_before"), F.coalesce("after", "_after")
    back, ahead = F.col("ts") - before["ts"], after["ts"] - F.col("ts")
    options = F.array(
        F.when(back <= tolerance_s, F.struct(back.alias("away"), (-before["id"]).alias("id"), before["ts"].alias("at"))),
        F.when(ahead <= tolerance_s, F.struct(ahead.alias("away"), after["id"].alias("id"), after["ts"].alias("at"))),
    )
    found = around.withColumn("_best", F.array_min(F.filter(options, lambda o: o.isNotNull())))
    return found.select("spike_id", *DEVICE, "ts", F.col("_best.id").alias("alert_id"), F.col("_best.at").alias("alert_ts"))


def least_label_in_reach(spikes: DataFrame, alerts: DataFrame, tolerance_s: float) -> DataFrame:
    """``alert_id`` and ``least``: the smallest label of the device's spikes within the tolerance of each alert.

    The reach of an alert, twice the tolerance long, covers the end of one bucket of that length and the beginning of the next: two running
    minima, whatever the number of spikes in it.
    """
    width, slack = 2 * tolerance_s, 1e-6
    none = F.lit(None).cast("long")

    def running(probe: Column, order: Column) -> DataFrame:
        points = spikes.select(*DEVICE, F.floor(F.col("ts") / width).alias("bucket"), F.col("ts").alias("at"), "spike_id", none.alias("alert_id"))
        probes = alerts.select(*DEVICE, F.floor(probe / width).alias("bucket"), probe.alias("at"), none.alias("spike_id"), "alert_id")
        over = Window.partitionBy(*DEVICE, "bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return points.unionByName(probes).withColumn("least", F.min("spike_id").over(over)).where(F.col("alert_id").isNotNull()).select("alert_id", "least")

    start = running(F.col("ts") - tolerance_s - slack, F.desc("at"))
    end = running(F.col("ts") + tolerance_s + slack, F.asc("at"))
    return start.unionByName(end).groupBy("alert_id").agg(F.min("least").alias("least"))


def settle_round(spikes: DataFrame, alerts: DataFrame, tolerance_s: float) -> DataFrame:
    """The spikes whose choice is final, with ``alert_id`` and ``alert_ts`` (null for those that no free alert is in reach of).

    A spike takes its closest free alert for certain if no free spike of a smaller label can reach that alert: nobody who chooses earlier
    can take it, and nothing closer can become free. The smallest label of all is always settled.
    """
    near = nearest_free(spikes, alerts, tolerance_s)
    contested = near.join(least_label_in_reach(spikes, alerts, tolerance_s), "alert_id", "left")
    final = F.col("alert_id").isNull() | (F.col("least") >= F.col("spike_id"))
    return contested.where(final).select("spike_id", *DEVICE, "ts", "alert_id", "alert_ts")


def match_alerts(
    spikes: DataFrame,
    alerts: DataFrame,
    tolerance_s: float = 90.0,
    partitions: int | None = None,
    piece_s: float | None = None,
    halo_s: float | None = None,
) -> DataFrame:
    """One row per spike and per unmatched alert.

    ``spikes``: spike_id (label order), device, ts in seconds. ``alerts``: alert_id (log order), device, ts or null.

    An alert without a time is at distance zero from any spike of its device, so the device's first spikes take
    those in order, by rank. The rest is split into clusters of spikes no further than twice the tolerance apart:
    no alert can be within reach of two clusters, so they are matched independently. Alerts out of reach of every
    spike never enter a group.

    A long cluster is matched in overlapping pieces. Only spikes within twice the tolerance compete for an alert, so
    if a piece and its neighbours agree on the spikes around their border, every spike has seen its competitors
    decide as they finally do, and the pieces together are the exact answer; that is so where labels run with time. Clusters whose
    pieces disagree go through rounds of window functions (``settle_round``), each of which settles every spike that nobody with a smaller label
    can harm: with labels in any other order that is a good part of them each time, and what is left falls into smaller clusters. When a round
    settles few, these are tried in pieces again. Settled clusters and spikes are never looked at again, and no group grows beyond a piece with its overlap.
    """
    spark = spikes.sparkSession
    ship_package(spark)
    # A border must show all competitors, and only direct neighbours lend points.
    halo_s = max(halo_s or 20 * tolerance_s, 2 * tolerance_s)
    piece_s = max(piece_s or 80 * tolerance_s, halo_s)
    none_long, none_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    columns = [*DEVICE, "spike_id", "alert_id", "spike_ts", "alert_ts"]
    dated = alerts.where(F.col("ts").isNotNull())
    undated = alerts.where(F.col("ts").isNull())
    results: list[DataFrame] = []
    if not undated.isEmpty():
        ranked_spikes = _numbered(spikes, "spike_id", partitions)
        ranked_alerts = _numbered(undated, "alert_id", partitions).select(*DEVICE, "row_number", "alert_id")
        paired = ranked_spikes.join(ranked_alerts, [*DEVICE, "row_number"], "full").select(
            *DEVICE, "spike_id", "alert_id", F.col("ts").alias("spike_ts"), none_double.alias("alert_ts")
        )
        results.append(paired.where(F.col("alert_id").isNotNull()))
        spikes = paired.where(F.col("alert_id").isNull()).select("spike_id", *DEVICE, F.col("spike_ts").alias("ts"))
    free_spikes, free_alerts = spikes.select("spike_id", *DEVICE, "ts"), dated.select("alert_id", *DEVICE, "ts")
    schema = ", ".join(f"{k} int" for k in DEVICE) + ", " + _MATCH + ", cluster double"
    while True:
        points = free_spikes.select(
            *DEVICE, (F.col("ts") - tolerance_s).alias("reach"), F.lit(0).alias("kind"), "ts", "spike_id", none_long.alias("alert_id")
        ).unionByName(
            free_alerts.select(*DEVICE, F.col("ts").alias("reach"), F.lit(1).alias("kind"), "ts", none_long.alias("spike_id"), "alert_id")
        )
        cover = Cover(width=2 * tolerance_s + 1e-6)
        clustered = fold_segments(points, DEVICE, ["reach", "kind", "spike_id", "alert_id"], cover, partitions)
        results.append(clustered.where(F.col("cluster").isNull()).select(*DEVICE, "spike_id", "alert_id", none_double.alias("spike_ts"), F.col("ts").alias("alert_ts")))
        inside = clustered.where(F.col("cluster").isNotNull())
        groups = _pieces(inside, piece_s, halo_s, tolerance_s).groupBy(*DEVICE, "cluster", "piece")
        matched = _stored(groups.applyInPandas(_with_device(_greedy(tolerance_s)), schema), "matched")
        decided = matched.where(F.col("core") & F.col("spike_id").isNotNull()).select("spike_id", F.col("alert_id").alias("_final"))
        seen = matched.where("band").select(*DEVICE, "cluster", "spike_id", "alert_id")
        torn = seen.join(decided, "spike_id").where(~F.col("alert_id").eqNullSafe(F.col("_final"))).select(*DEVICE, "cluster").distinct()
        core = matched.where("core")
        if torn.isEmpty():
            results.append(core.select(*columns))
            break
        torn = _stored(torn, "torn")
        results.append(core.join(torn, [*DEVICE, "cluster"], "left_anti").select(*columns))
        left = core.join(torn, [*DEVICE, "cluster"], "left_semi")
        free_spikes = left.where(F.col("spike_id").isNotNull()).select("spike_id", *DEVICE, F.col("spike_ts").alias("ts"))
        # an alert is on a spike's row if that piece gave it away, and on its own if not
        open_alerts = dated.select("alert_id", *DEVICE, "ts").join(inside.join(torn, [*DEVICE, "cluster"], "left_semi").where("kind = 1").select("alert_id"), "alert_id", "left_semi")
        free_spikes, free_alerts = _stored(free_spikes, "free-spikes"), _stored(open_alerts, "free-alerts")
        waiting = free_spikes.count()
        while waiting:
            settled = _stored(settle_round(free_spikes, free_alerts, tolerance_s), "settled")
            results.append(settled.select(*DEVICE, "spike_id", "alert_id", F.col("ts").alias("spike_ts"), "alert_ts"))
            free_spikes = _stored(free_spikes.join(settled.select("spike_id"), "spike_id", "left_anti"), "free-spikes")
            free_alerts = _stored(free_alerts.join(settled.select("alert_id"), "alert_id", "left_anti"), "free-alerts")
            before, waiting = waiting, free_spikes.count()
            if waiting <= SMALL or before - waiting < before / FEW:
                break
        piece_s = WHOLE_S if waiting <= SMALL else piece_s
    return reduce(DataFrame.unionByName, results)


def _with_device(match):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = match(rows)
        for i, name in enumerate(DEVICE):
            out.insert(i, name, int(key[i]))
        return out.assign(cluster=float(key[len(DEVICE)]))

    return run


def detection_scores(matches: DataFrame, minutes: float) -> DataFrame:
    """True and false positives, misses and the usual ratios; a zero denominator gives null."""
    hit = F.col("spike_id").isNotNull() & F.col("alert_id").isNotNull()
    counts = matches.agg(
        F.count_if(hit).alias("tp"),
        F.count_if(F.col("spike_id").isNull()).alias("fp"),
        F.count_if(F.col("alert_id").isNull()).alias("fn"),
        F.avg(F.when(hit, F.col("alert_ts") - F.col("spike_ts"))).alias("mean_latency_s"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    with_rates = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    both = F.col("precision") + F.col("recall")
    return with_rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).withColumn(
        "fp_per_min", fp / F.lit(max(minutes, 1e-9))
    )
