"""Greedy matching of alerts to labelled spikes against a plain loop."""

import numpy as np
import pandas as pd
import pytest

from meterflow.operators.matching import detection_scores, match_alerts, nearest_first, settle_round


def labelled(seed, n_spikes, n_alerts, span, undated=0.0):
    rng = np.random.default_rng(seed)

    def device(n):
        plug = np.where(rng.random(n) < 0.5, 0, rng.integers(0, 6, n))
        return {"house_id": plug // 2, "household_id": np.zeros(n, int), "plug_id": plug}

    spikes = pd.DataFrame({"spike_id": np.arange(n_spikes), **device(n_spikes), "ts": rng.integers(0, span, n_spikes) * 1.0})
    times = rng.integers(0, span, n_alerts) + rng.choice([0.0, 0.25, 0.5], n_alerts)
    missing = rng.random(n_alerts) < undated
    alerts = pd.DataFrame({"alert_id": np.arange(n_alerts), **device(n_alerts), "ts": times})
    alerts["ts"] = alerts["ts"].astype(object).where(~missing, None)
    return spikes, alerts


def loop(spikes, alerts, tol):
    pool = [dict(r._asdict(), used=False) for r in alerts.itertuples(index=False)]
    pairs = {}
    for s in spikes.itertuples(index=False):
        near = [
            a for a in pool
            if not a["used"] and (a["house_id"], a["household_id"], a["plug_id"]) == (s.house_id, s.household_id, s.plug_id)
            and (a["ts"] is None or abs(a["ts"] - s.ts) <= tol)
        ]
        if near:
            best = min(near, key=lambda a: (0.0 if a["ts"] is None else abs(a["ts"] - s.ts), a["ts"] is not None, a["alert_id"]))
            best["used"] = True
            pairs[s.spike_id] = best["alert_id"]
        else:
            pairs[s.spike_id] = None
    return pairs, {a["alert_id"] for a in pool if not a["used"]}


SCHEMA_S = "spike_id long, house_id int, household_id int, plug_id int, ts double"
SCHEMA_A = "alert_id long, house_id int, household_id int, plug_id int, ts double"


def frames(spark, spikes, alerts):
    cast = lambda df: [tuple(None if v is None else (float(v) if i == 4 else int(v)) for i, v in enumerate(r)) for r in df.itertuples(index=False)]
    return spark.createDataFrame(cast(spikes), SCHEMA_S), spark.createDataFrame(cast(alerts), SCHEMA_A)


@pytest.mark.parametrize("seed,span,undated,partitions", [(1, 20_000, 0.0, 9), (2, 3_000, 0.0, 1), (3, 60_000, 0.1, 9)])
def test_greedy_equals_loop(spark, seed, span, undated, partitions):
    spikes, alerts = labelled(seed, 300, 350, span, undated)
    pairs, unused = loop(spikes, alerts, 90.0)
    got = match_alerts(*frames(spark, spikes, alerts), 90.0, partitions).collect()
    assert {r.spike_id: r.alert_id for r in got if r.spike_id is not None} == pairs
    assert {r.alert_id for r in got if r.spike_id is None} == unused
    assert len(got) == len(spikes) + len(unused)


@pytest.mark.parametrize("seed,span,piece,halo", [(4, 4_000, 500.0, 100.0), (5, 2_000, 200.0, 1.0), (6, 20_000, 1000.0, 300.0)])
def test_long_clusters_in_pieces(spark, seed, span, piece, halo):
    """Dense spikes chain into long clusters; short overlaps first disagree and are then widened."""
    spikes, alerts = labelled(seed, 300, 300, span)
    if seed != 5:
        spikes = spikes.sort_values("ts").assign(spike_id=range(len(spikes)))
    pairs, unused = loop(spikes, alerts, 90.0)
    got = match_alerts(*frames(spark, spikes, alerts), 90.0, piece_s=piece, halo_s=halo).collect()
    assert {r.spike_id: r.alert_id for r in got if r.spike_id is not None} == pairs
    assert {r.alert_id for r in got if r.spike_id is None} == unused
    assert len(got) == len(spikes) + len(unused)


@pytest.mark.parametrize("order", ["random", "with time", "against time"])
def test_one_cluster_as_long_as_the_device(spark, order):
    """Spikes of one device closer than the tolerance from first to last: one cluster, labels in any order."""
    rng = np.random.default_rng(8)
    n = 600
    times = np.cumsum(rng.integers(10, 80, n)) * 1.0
    ids = {"random": rng.permutation(n), "with time": np.arange(n), "against time": np.arange(n)[::-1]}[order]
    spikes = pd.DataFrame({"spike_id": ids, "house_id": 1, "household_id": 0, "plug_id": 2, "ts": times}).sort_values("spike_id")
    moved = rng.choice(times, n, replace=True) + rng.integers(-60, 61, n)
    alerts = pd.DataFrame({"alert_id": np.arange(n), "house_id": 1, "household_id": 0, "plug_id": 2, "ts": moved})
    pairs, unused = loop(spikes, alerts, 90.0)
    got = match_alerts(*frames(spark, spikes, alerts), 90.0, piece_s=1500.0, halo_s=200.0).collect()
    assert {r.spike_id: r.alert_id for r in got if r.spike_id is not None} == pairs
    assert {r.alert_id for r in got if r.spike_id is None} == unused and len(got) == n + len(unused)


def test_a_round_settles_only_final_choices(spark):
    spikes, alerts = labelled(9, 200, 220, 6_000)
    pairs, _ = loop(spikes, alerts, 90.0)
    settled = settle_round(*frames(spark, spikes, alerts), 90.0).collect()
    assert len(settled) > 20 and all(pairs[r.spike_id] == r.alert_id for r in settled)
    assert min(spikes.spike_id) in {r.spike_id for r in settled}


def test_two_spikes_compete_and_undated_alert(spark):
    spikes = pd.DataFrame([(0, 1, 0, 2, 100.0), (1, 1, 0, 2, 110.0), (2, 2, 0, 0, 5.0)], columns=["spike_id", "house_id", "household_id", "plug_id", "ts"])
    alerts = pd.DataFrame([(0, 1, 0, 2, 108.0), (1, 1, 0, 2, 900.0), (2, 2, 0, 0, None)], columns=["alert_id", "house_id", "household_id", "plug_id", "ts"], dtype=object)
    got = match_alerts(*frames(spark, spikes, alerts), 90.0)
    scores = detection_scores(got, 10.0).first()
    assert (scores.tp, scores.fp, scores.fn) == (2, 1, 1)
    assert scores.mean_latency_s == 8.0
    assert scores.precision == pytest.approx(2 / 3) and scores.recall == pytest.approx(2 / 3)
    assert scores.fp_per_min == pytest.approx(0.1)


def test_no_alerts_gives_null_precision(spark):
    spikes, alerts = labelled(1, 5, 5, 100)
    s, a = frames(spark, spikes, alerts)
    scores = detection_scores(match_alerts(s, a.where("alert_id < 0"), 90.0), 1.0).first()
    assert (scores.tp, scores.fp, scores.fn, scores.precision, scores.recall) == (0, 0, 5, None, 0.0)


def test_nearest_equals_loop(spark):
    spikes, alerts = labelled(5, 300, 300, 30_000)
    got = {r.spike_id: r.nearest_alert_ts for r in nearest_first(*frames(spark, spikes, alerts), 90.0).collect()}
    assert len(got) == len(spikes)
    for s in spikes.itertuples():
        near = [a.ts for a in alerts.itertuples() if a.plug_id == s.plug_id and a.house_id == s.house_id and abs(a.ts - s.ts) <= 90]
        assert got[s.spike_id] == (min(near, key=lambda t: (abs(t - s.ts), t)) if near else None)
