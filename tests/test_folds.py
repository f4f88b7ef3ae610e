"""Segmented folds against plain loops, on histories cut into many segments and with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterflow.operators import cooldown as cooldown_graph
from meterflow.operators import ranks
from meterflow.operators.folds import cooldown, ewma_baseline, paced, with_previous
from meterflow.operators.ranks import exact_percentiles


def hot_frame(seed=1, rows=3000, spread=40_000):
    """One key owns about half of all rows; times repeat."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < 0.5, 7, rng.integers(0, 30, rows))
    t = np.sort(rng.integers(0, spread, rows))
    return pd.DataFrame({"k": key, "event_ms": t, "i": np.arange(rows), "value": np.round(rng.gamma(2.0, 300.0, rows), 2)})


def groups(frame):
    for _, g in frame.sort_values(["k", "event_ms", "i"]).groupby("k"):
        yield g


@pytest.fixture(scope="module")
def frame():
    return hot_frame()


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_baseline_equals_loop(spark, frame, partitions):
    expected = {}
    for g in groups(frame):
        mean = var = 0.0
        for n, row in enumerate(g.itertuples()):
            expected[row.i] = (mean, var, n)
            if n == 0:
                mean = row.value
            else:
                gap = row.value - mean
                mean += 0.3 * gap
                var = 0.7 * (var + 0.3 * gap * gap)
    got = ewma_baseline(spark.createDataFrame(frame), ["k"], ["event_ms", "i"], 0.3, partitions=partitions).toPandas()
    assert len(got) == len(frame)
    for row in got.itertuples():
        mean, var, n = expected[row.i]
        assert row.seen_before == n
        assert row.mean_before == pytest.approx(mean, rel=1e-9, abs=1e-9)
        assert row.var_before == pytest.approx(var, rel=1e-8, abs=1e-7)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("wait", [1, 60, 5000])
@pytest.mark.parametrize("partitions", [1, 16])
def test_cooldown_equals_loop(spark, frame, wait, strict, partitions):
    expected = set()
    for g in groups(frame):
        last = None
        for row in g.itertuples():
            if last is None or (row.event_ms - last > wait if strict else row.event_ms - last >= wait):
                last = row.event_ms
                expected.add(row.i)
    got = cooldown(spark.createDataFrame(frame), ["k"], ["event_ms", "i"], wait, strict, partitions=partitions)
    assert {r.i for r in got.where("fired").select("i").collect()} == expected
    assert got.count() == len(frame)


def test_cooldown_longer_than_segments(spark):
    """A hot key whose segments are all shorter than the wait: step tables of more than one row."""
    frame = pd.DataFrame({"k": 1, "event_ms": np.arange(20_000), "i": np.arange(20_000)})
    for wait, strict in [(4_000, False), (7_001, True)]:
        got = cooldown(spark.createDataFrame(frame), ["k"], ["event_ms", "i"], wait, strict, partitions=12)
        times = [r.i for r in got.where("fired").orderBy("i").select("i").collect()]
        assert times == list(range(0, 20_000, wait + strict))


def test_a_hot_key_spreads_over_its_times(spark):
    """A key with nearly all rows and a wait longer than any partition's share: no task of the links or of the marking gets its rows."""
    rows = spark.range(40_000).select(F.lit("hot").alias(cooldown_graph.KEY), (F.col("id") * 3).alias("t"))
    times = rows.withColumn("bucket", F.floor(F.col("t") / 500))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows end in one partition anyway
    try:
        found = cooldown_graph.links(times, 500)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 40_000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    marked = cooldown_graph.on_chains(times, 500)
    assert sorted(r.t for r in marked.collect()) == list(range(0, 120_000, 501)) and marked.select("t").distinct().count() == marked.count()


@pytest.mark.parametrize("partitions", [1, 16])
def test_pacing_equals_loop(spark, frame, partitions):
    expected = {}
    for g in groups(frame):
        last = None
        for row in g.itertuples():
            last = row.event_ms if last is None else max(row.event_ms, last + 25)
            expected[row.i] = last
    got = paced(spark.createDataFrame(frame), ["k"], ["event_ms", "i"], 25, partitions=partitions).collect()
    assert {r.i: r.send_ms for r in got} == expected


@pytest.mark.parametrize("partitions", [1, 16])
def test_previous_equals_shift(spark, frame, partitions):
    ordered = frame.sort_values(["k", "event_ms", "i"])
    one, two = ordered.groupby("k")["value"].shift(1), ordered.groupby("k")["value"].shift(2)
    expected = {i: (a, b) for i, a, b in zip(ordered.i, one, two)}
    got = with_previous(spark.createDataFrame(frame), ["k"], ["event_ms", "i"], "value", 2, partitions).collect()
    assert len(got) == len(frame)
    for row in got:
        a, b = expected[row.i]
        assert (row.value_prev1 is None) == (a != a) and (row.value_prev2 is None) == (b != b)
        assert row.value_prev1 is None or row.value_prev1 == a
        assert row.value_prev2 is None or row.value_prev2 == b


@pytest.mark.parametrize("partitions", [1, 16])
def test_percentiles_equal_numpy(spark, frame, partitions):
    got = exact_percentiles(spark.createDataFrame(frame), ["k"], "value", [0.0, 0.5, 0.95, 0.99, 1.0], partitions)
    rows = {r.k: r for r in got.collect()}
    for k, g in frame.groupby("k"):
        for p in (0, 50, 95, 99, 100):
            assert rows[k][f"value_p{p}"] == pytest.approx(np.percentile(g.value, p), abs=1e-9)


def test_percentiles_by_refined_digits(spark, monkeypatch):
    """With no value few enough, every digit is looked at: neighbours in the last bits, both signs, zeros, whole numbers."""
    monkeypatch.setattr(ranks, "FEW", 0)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1e-3, 60), [0.0, -0.0, 1e300, -1e300, 5.0], np.nextafter(5.0, 6) * np.ones(3), [5.0 + 1e-15 * k for k in range(9)]])
    for column, kind in ((values, "double"), (rng.integers(-(2**40), 2**40, 50), "long")):
        rows = [(k % 2, v.item()) for k, v in enumerate(column)] + [(0, None)]
        got = {r.k: r for r in exact_percentiles(spark.createDataFrame(rows, f"k int, v {kind}"), ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
        for k in (0, 1):
            for p in (0, 50, 95, 100):
                want = np.percentile([v for i, v in rows if i == k and v is not None], p)
                assert got[k][f"v_p{p}"] == pytest.approx(want, rel=1e-12, abs=1e-15)


def test_empty_input(spark, frame):
    empty = spark.createDataFrame(frame).where("k < 0")
    assert cooldown(empty, ["k"], ["event_ms", "i"], 60).count() == 0
    assert ewma_baseline(empty, ["k"], ["event_ms", "i"], 0.3).count() == 0


@pytest.mark.parametrize("batch", [3, 10_000])
def test_null_keys_and_batch_borders(spark, batch):
    """Nulls turn whole-number keys of a batch into floats in pandas; the key of a row must not change with it."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 8, None if i % 2 else "a", i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, j string, event_ms long, value double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for partitions in (1, 5):
            got = ewma_baseline(df, ["k", "j"], ["event_ms"], 0.3, partitions=partitions).collect()
            seen = {}
            for r in sorted(got, key=lambda r: r.event_ms):
                assert r.seen_before == seen.get((r.k, r.j), 0)
                seen[r.k, r.j] = r.seen_before + 1
            assert len(got) == 60 and len(seen) == 6
            fired = cooldown(df, ["k", "j"], ["event_ms"], 1000, partitions=partitions).where("fired").collect()
            assert sorted(r.event_ms for r in fired) == [0, 1, 2, 3, 4, 5]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
