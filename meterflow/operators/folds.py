"""The ordered computations: moving baseline, paced dispatch, previous rows, runs and clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from meterflow.operators.cooldown import cooldown
from meterflow.operators.segments import State, fold_segments

__all__ = ["Baseline", "Cover", "Pacing", "Previous", "RowNumber", "Streak", "cooldown", "ewma_baseline", "paced", "with_previous", "with_streak"]

NEGLIGIBLE = 1e-120


def _affine_scan(gain: np.ndarray, shift: np.ndarray, entering: float) -> np.ndarray:
    """``y[i] = gain[i] * y[i-1] + shift[i]`` for all i, by doubling.

    Gains shrink quickly; one below ``NEGLIGIBLE`` can no longer move any digit of the result and is dropped, which
    ends the doubling early and keeps denormal numbers, a hundred times slower, out of the products.
    """
    gain, shift = gain.copy(), shift.copy()
    step = 1
    while step < len(gain) and gain[step:].any():
        shift[step:] += gain[step:] * shift[:-step]
        gain[step:] *= gain[:-step]
        gain[gain < NEGLIGIBLE] = 0.0
        step *= 2
    return shift + gain * entering


def _shifted(values: np.ndarray, starts: np.ndarray, entering: float) -> np.ndarray:
    """Value after the previous row of the same key; zero at the start of a key."""
    out = np.empty_like(values)
    out[0] = entering
    out[1:] = values[:-1]
    out[starts] = 0.0
    return out


@dataclass
class Baseline:
    """Exponentially weighted mean and variance, as they stood *before* each row.

    With weight ``a`` both updates are affine in the previous state: ``m' = (1-a) m + a x`` and, the deviations
    being known, ``v' = (1-a)(v + a d^2)``. A key's first value seeds the mean. For a run that starts from an
    unknown mean, the deviation from the run's first value decays by ``1-a`` per row, which makes the outgoing
    variance a quadratic in that deviation.
    """

    alpha: float
    value: str = "value"
    inputs: list[str] = field(init=False)
    outputs = [("mean_before", "double"), ("var_before", "double"), ("seen_before", "long")]
    state_size = 3

    def __post_init__(self):
        self.inputs = [self.value]

    def _advance(self, x: np.ndarray, starts: np.ndarray, mean: float, var: float):
        keep = 1.0 - self.alpha
        gain = np.where(starts, 0.0, keep)
        means = _affine_scan(gain, np.where(starts, x, self.alpha * x), mean)
        before = _shifted(means, starts, mean)
        gap = np.where(starts, 0.0, x - before)
        variances = _affine_scan(gain, keep * self.alpha * gap * gap, var)
        return means, variances, before, _shifted(variances, starts, var), gap

    def effect(self, parts: Iterator[dict[str, np.ndarray]], whole: bool) -> Iterator[State]:
        keep, rows, seed, mean, var, gaps = 1.0 - self.alpha, 0, 0.0, 0.0, 0.0, 0.0
        for part in parts:
            x = part[self.value].astype(float)
            if rows == 0:
                seed = mean = float(x[0])
            means, variances, _, _, gap = self._advance(x, np.zeros(len(x), bool), mean, var)
            mean, var, gaps, rows = float(means[-1]), float(variances[-1]), gaps + float(gap.sum()), rows + len(x)
        decay = keep**rows
        linear = -2.0 * self.alpha * decay * gaps
        square = decay * (1.0 - decay)
        yield [rows, seed, mean, var, decay, linear, square]

    def follow(self, state: State | None, effects: Iterator[State]) -> State:
        rows, seed, mean, var, decay, linear, square = next(effects)
        if state is None:
            return [mean, var, rows]
        shift = state[0] - seed
        return [mean + decay * shift, decay * state[1] + var + linear * shift + square * shift * shift, state[2] + rows]

    def scan(self, rows, starts, state):
        x = rows[self.value].astype(float)
        mean, var, seen = state if state is not None else (0.0, 0.0, 0.0)
        means, variances, before, var_before, _ = self._advance(x, starts, mean, var)
        count = np.arange(len(x), dtype=np.int64)
        last_start = np.maximum.accumulate(np.where(starts, count, -1))
        seen_before = np.where(last_start < 0, count + int(seen), count - last_start)
        out = {
            "mean_before": before,
            "var_before": np.maximum(var_before, 0.0),
            "seen_before": seen_before,
        }
        return out, [float(means[-1]), float(variances[-1]), float(seen_before[-1] + 1)]


@dataclass
class Pacing:
    """Send times spaced by at least ``interval`` per destination: ``send = max(t, previous send + interval)``."""

    interval: int
    time: str = "event_ms"
    inputs: list[str] = field(init=False)
    outputs = [("send_ms", "long")]
    state_size = 1

    def __post_init__(self):
        self.inputs = [self.time]

    def effect(self, parts: Iterator[dict[str, np.ndarray]], whole: bool) -> Iterator[State]:
        rows, peak = 0, -np.inf
        for part in parts:
            t = part[self.time].astype(np.int64)
            peak = max(peak, float((t - (rows + np.arange(len(t))) * self.interval).max()))
            rows += len(t)
        yield [rows, peak]

    def follow(self, state: State | None, effects: Iterator[State]) -> State:
        rows, peak = next(effects)
        own = peak + (rows - 1) * self.interval
        return [own if state is None else max(own, state[0] + rows * self.interval)]

    def scan(self, rows, starts, state):
        t = rows[self.time].astype(np.int64)
        send = np.empty(len(t), dtype=np.int64)
        bounds = [0, *[int(b) for b in np.flatnonzero(starts) if b > 0], len(t)]
        last = None if state is None else int(state[0])
        for begin, end in zip(bounds[:-1], bounds[1:]):
            steps = np.arange(end - begin, dtype=np.int64) * self.interval
            own = np.maximum.accumulate(t[begin:end] - steps) + steps
            if last is not None:
                own = np.maximum(own, last + self.interval + steps)
            send[begin:end] = own
            last = int(own[-1]) if end == len(t) else None
        return {"send_ms": send}, [float(send[-1])]


@dataclass
class Previous:
    """Values of one column in the ``depth`` rows before each row of the same key; null where there is none."""

    column: str
    depth: int = 1
    inputs: list[str] = field(init=False)
    outputs: list[tuple[str, str]] = field(init=False)
    state_size: int = field(init=False)

    def __post_init__(self):
        self.inputs, self.state_size = [self.column], self.depth
        self.outputs = [(f"{self.column}_prev{i}", "double") for i in range(1, self.depth + 1)]

    def effect(self, parts: Iterator[dict[str, np.ndarray]], whole: bool) -> Iterator[State]:
        tail = np.empty(0)
        for part in parts:
            tail = np.concatenate([tail, part[self.column].astype(float)])[-self.depth :]
        yield tail.tolist()

    def follow(self, state: State | None, effects: Iterator[State]) -> State:
        return [*(state or []), *next(effects)][-self.depth :]

    def scan(self, rows, starts, state):
        x = rows[self.column].astype(float)
        earlier = np.array(state or [], dtype=float)
        padded = np.concatenate([np.full(self.depth - len(earlier), np.nan), earlier, x])
        index = np.arange(len(x))
        last_start = np.maximum.accumulate(np.where(starts, index, -1))
        room = np.where(last_start < 0, index + len(earlier), index - last_start)
        out = {}
        for i in range(1, self.depth + 1):
            shifted = padded[self.depth - i : self.depth - i + len(x)]
            out[f"{self.column}_prev{i}"] = pd.arrays.FloatingArray(shifted.copy(), room < i)
        tail_start = max(int(last_start[-1]), 0)
        tail = x[tail_start:] if last_start[-1] >= 0 else np.concatenate([earlier, x])
        return out, tail[-self.depth :].tolist()


@dataclass
class RowNumber:
    """Position of a row within its key, from zero; ``column`` only names a cheap input."""

    column: str
    inputs: list[str] = field(init=False)
    outputs = [("row_number", "long")]
    state_size = 1

    def __post_init__(self):
        self.inputs = [self.column]

    def effect(self, parts: Iterator[dict[str, np.ndarray]], whole: bool) -> Iterator[State]:
        yield [sum(len(part[self.column]) for part in parts)]

    def follow(self, state: State | None, effects: Iterator[State]) -> State:
        return [next(effects)[0] + (state[0] if state else 0)]

    def scan(self, rows, starts, state):
        index = np.arange(len(starts), dtype=np.int64)
        last_start = np.maximum.accumulate(np.where(starts, index, -1))
        number = np.where(last_start < 0, index + int(state[0] if state else 0), index - last_start)
        return {"row_number": number}, [float(number[-1] + 1)]


@dataclass
class Streak:
    """How many rows in a row, up to each one, had an empty queue and a counter above the row's before.

    Before the first row of a key the counter is 0. Only the first row of a run depends on what came before.
    """

    empty: str
    counter: str
    inputs: list[str] = field(init=False)
    outputs = [("streak", "long")]
    state_size = 2

    def __post_init__(self):
        self.inputs = [self.empty, self.counter]

    @staticmethod
    def _lengths(good: np.ndarray, starts: np.ndarray, entering: float) -> np.ndarray:
        """Length of the run that ends in each row; ``entering`` is that of the row before the first."""
        at = np.arange(len(good))
        bad = np.maximum.accumulate(np.where(good, -1, at))
        begun = np.maximum.accumulate(np.where(starts, at, -1))
        since = np.maximum(bad, begun - 1)
        return np.where(since >= 0, at - since, at + 1 + int(entering))

    def effect(self, parts: Iterator[dict[str, np.ndarray]], whole: bool) -> Iterator[State]:
        first, last, rows, run, unbroken = None, 0.0, 0, 0.0, True
        for part in parts:
            counter, empty = part[self.counter].astype(float), part[self.empty] == 0
            good = empty & (counter > np.concatenate([[last], counter[:-1]]))
            if first is None:
                first = (float(counter[0]), float(empty[0]))
                good[0] = True
            run = float(self._lengths(good, np.zeros(len(good), dtype=bool), run)[-1])
            unbroken, last, rows = unbroken and bool(good.all()), float(counter[-1]), rows + len(counter)
        yield [*first, float(unbroken), run, rows, last]

    def follow(self, state: State | None, effects: Iterator[State]) -> State:
        counter, empty, unbroken, run, rows, last = next(effects)
        before, streak = state or (0.0, 0.0)
        if unbroken:
            run = rows + streak if empty and counter > before else rows - 1
        return [last, run]

    def scan(self, rows, starts, state):
        counter = rows[self.counter].astype(float)
        last, streak = state or (0.0, 0.0)
        before = np.concatenate([[last], counter[:-1]])
        before[starts] = 0.0
        good = (rows[self.empty] == 0) & (counter > before)
        lengths = self._lengths(good, starts, streak)
        return {"streak": lengths}, [float(counter[-1]), float(lengths[-1])]


@dataclass
class Cover:
    """Clusters of intervals ``[reach, reach + width]`` opened by rows of kind 0; rows of kind 1 fall inside or not.

    ``cluster`` is the opening of the first interval of an overlapping run, null for an uncovered row.
    """

    width: float
    inputs = ["reach", "kind"]
    outputs = [("cluster", "double")]
    state_size = 2

    def effect(self, parts: Iterator[dict[str, np.ndarray]], whole: bool) -> Iterator[State]:
        """First and last opening, and the last cluster's start if the run contains a break."""
        first = last = start = np.nan
        for part in parts:
            opened = part["reach"][part["kind"] == 0]
            if not len(opened):
                continue
            first = opened[0] if first != first else first
            chained = np.concatenate([[last], opened])
            breaks = opened[np.flatnonzero(np.diff(chained) > self.width)]
            start = breaks[-1] if len(breaks) else start
            last = opened[-1]
        yield [first, last, start]

    def follow(self, state: State | None, effects: Iterator[State]) -> State:
        first, last, start = next(effects)
        if first != first:
            return list(state) if state else [np.nan, np.nan]
        if start != start:
            joins = state is not None and first - state[0] <= self.width
            start = state[1] if joins else first
        return [last, start]

    def scan(self, rows, starts, state):
        reach, opens = rows["reach"].astype(float), rows["kind"] == 0
        index = np.arange(len(reach))
        key_start = np.maximum.accumulate(np.where(starts, index, -1))
        last_open, last_cluster = state if state else (np.nan, np.nan)
        opened = np.flatnonzero(opens)
        cluster = np.full(len(reach), np.nan)
        latest = np.full(len(reach), np.nan)
        previous = np.empty(len(opened))
        if len(opened):
            previous[0] = last_open
            previous[1:] = reach[opened[:-1]]
            new_key = np.append(True if key_start[opened[0]] >= 0 else False, key_start[opened[1:]] != key_start[opened[:-1]])
            previous[new_key] = np.nan
            breaks = ~(reach[opened] - previous <= self.width)
            at = np.maximum.accumulate(np.where(breaks, np.arange(len(opened)), -1))
            cluster_start = np.where(at >= 0, reach[opened][at], last_cluster)
            place = np.searchsorted(opened, index, side="right") - 1
            known = place >= 0
            same = known & (key_start == key_start[opened[place]])
            latest[same] = reach[opened[place[same]]]
            cluster[same] = cluster_start[place[same]]
        carried = np.isnan(latest) & (key_start < 0)
        latest[carried], cluster[carried] = last_open, last_cluster
        covered = reach - latest <= self.width
        return {"cluster": pd.arrays.FloatingArray(cluster, ~covered)}, [float(latest[-1]), float(cluster[-1])]


def ewma_baseline(
    df: DataFrame, keys: list[str], order: list[str], alpha: float, value: str = "value", partitions: int | None = None
) -> DataFrame:
    return fold_segments(df, keys, order, Baseline(alpha, value), partitions)


def paced(
    df: DataFrame, keys: list[str], order: list[str], interval_ms: int, time: str = "event_ms", partitions: int | None = None
) -> DataFrame:
    return fold_segments(df, keys, order, Pacing(interval_ms, time), partitions)


def with_streak(df: DataFrame, keys: list[str], order: list[str], empty: str, counter: str, partitions: int | None = None) -> DataFrame:
    return fold_segments(df, keys, order, Streak(empty, counter), partitions)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], column: str, depth: int = 1, partitions: int | None = None
) -> DataFrame:
    return fold_segments(df, keys, order, Previous(column, depth), partitions)
