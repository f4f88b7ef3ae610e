"""Per-device baseline and cooldown kept across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meterflow.operators.anomaly import Detector
from meterflow.operators.folds import Baseline
from meterflow.schemas import DEVICE
from meterflow.session import ship_package, use_rocksdb
from meterflow.streaming.partials import FLUSH_INTERVAL

_BASELINE = "mean double, variance double, seen long"
_PAUSE = "last_fired long"
_OUT = (
    "event_id long, event_ms long, value double, plug_id int, household_id int, house_id int, mean_before double, var_before double, "
    "seen_before long, type string, z_score double, severity string, anomaly boolean, fired boolean"
)
_READ = ["event_id", "event_ms", "value"]
SLICE_ROWS = 10_000
COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


class Scores(StatefulProcessor):
    """One device: its baseline and the time of its last alert, as two values of the state store.

    Of a micro-batch's readings only identifier, time and value are held, 24 bytes each, until they are in order; they are scored and leave
    in slices then. How many there are at once the source's limit decides, not the device's history.
    """

    def __init__(self, detector: Detector):
        self.detector = detector

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.baseline = handle.getValueState("baseline", _BASELINE)
        self.pause = handle.getValueState("pause", _PAUSE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held, last = self.baseline.get(), self.pause.get()
        held, last = (list(held) if held else None), (last[0] if last else None)
        parts = [[batch[c].to_numpy() for c in _READ] for batch in rows if len(batch)]
        ids, times, values = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((ids, times))
        for since in range(0, len(order), SLICE_ROWS):
            at = order[since : since + SLICE_ROWS]
            batch = pd.DataFrame({"event_id": ids[at], "event_ms": times[at], "value": values[at]}).assign(**dict(zip(DEVICE, key)))
            scored, held = self._scored(batch, held)
            fired, last = self._fired(scored, last)
            yield scored.assign(fired=fired)[COLUMNS]
        if held is not None:
            self.baseline.update((held[0], held[1], int(held[2])))
        if last is not None:
            self.pause.update((int(last),))

    def close(self) -> None:
        pass

    def _scored(self, rows: pd.DataFrame, held: list | None) -> tuple[pd.DataFrame, list]:
        """The readings with the baseline before each and the verdict, and the baseline after them."""
        d = self.detector
        starts = np.zeros(len(rows), dtype=bool)
        starts[0] = held is None
        out, after = Baseline(d.alpha).scan({"value": rows["value"].to_numpy(float)}, starts, held)
        value, mean = rows["value"].to_numpy(float), out["mean_before"]
        std = np.maximum(np.sqrt(out["var_before"]), d.min_std)
        distance = np.where(out["seen_before"] >= d.warmup, (value - mean) / std, 0.0)
        over = (value >= d.hard_ceiling) & (d.hard_ceiling > 0)
        far = np.abs(distance) >= d.z_threshold
        kind = np.where(over, "HARD_CEILING", np.where(far, "Z_SCORE", "NORMAL"))
        severity = np.where(over, "CRITICAL", np.where(far, "WARNING", "NONE"))
        return rows.assign(**out, type=kind, z_score=np.where(over, 0.0, distance), severity=severity, anomaly=over | far), after

    def _fired(self, scored: pd.DataFrame, last: int | None) -> tuple[np.ndarray, int | None]:
        """Which anomalies fire, from one to the next by binary search, and the time of the last that did."""
        odd = np.flatnonzero(scored["anomaly"].to_numpy())
        times, fired = scored["event_ms"].to_numpy()[odd], np.zeros(len(scored), dtype=bool)
        at = 0 if last is None else int(np.searchsorted(times, last + self.detector.cooldown_ms))
        while at < len(odd):
            fired[odd[at]], last = True, int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + self.detector.cooldown_ms)))
        return fired, last


def stream_scores(readings: DataFrame, detector: Detector) -> DataFrame:
    """Every reading with its verdict and whether it fired. A device's state is two small rows in RocksDB."""
    ship_package(readings.sparkSession)
    use_rocksdb(readings.sparkSession)
    rows = readings.select("event_id", "event_ms", "value", *reversed(DEVICE))
    return rows.groupBy(*DEVICE).transformWithStateInPandas(Scores(detector), _OUT, "append", "none")


def start_scores(
    readings: DataFrame, detector: Detector, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    writer = (
        stream_scores(readings, detector)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": FLUSH_INTERVAL}
    return writer.trigger(**trigger).start()
