"""Ordered per-key state over data of any skew.

A fold over one key's history cannot simply be grouped by that key: a single key may hold a third of all rows.
Here the rows are range-partitioned by (keys, order), so a long history is cut into as many segments as its
size deserves, and the fold runs in two parallel scans over the sorted segments:

1. every segment reports what its *last* key's run does to an incoming state (one small row per segment);
2. those rows, at most one per partition, are chained in segment order into the state entering each segment;
3. every segment is scanned again, batch by batch, starting from that state.

Only the first key of a segment can continue an earlier one, so one incoming state per segment is enough. Keys are
compared as one text per row, made in the JVM with nulls written out, so that neither nulls nor the number types of a
batch change what counts as the same key. The chain of step 2 runs per key: the segments of different keys are chained
in different tasks.

The sorted rows are written as Parquet in between, so both scans see the same segments, also after the loss of an executor, and the first
one reads the key and the fold's inputs only. A segment is one file of one row group: whichever task reads it reads it whole and in order.
Every row carries its place, from which the segment follows; a scan that does not begin a segment at its first place stops.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.session import scratch_path, ship_package

#: Rows of a segment, as a power of two, and bytes of a row group, more than the rows of a segment take.
SEGMENT_BITS, ROW_GROUP = 20, 1 << 30
PLACE = "_place"
SEGMENT = "_segment"
KEY = "_key"
ENTERING = "_entering"
STATE = "_state"

State = list[float]
_SUMMARY = f"{SEGMENT} long, {KEY} string, part int, whole boolean, effect array<double>"
_CARRY = f"{SEGMENT} long, {STATE} array<double>"


class Fold(Protocol):
    """One ordered computation with a state small enough to hand from segment to segment."""

    inputs: list[str]
    outputs: list[tuple[str, str]]
    state_size: int

    def effect(self, parts: Iterator[dict[str, np.ndarray]], whole: bool) -> Iterator[State]:
        """What a run of rows of one key does to an incoming state, as one or more flat vectors.

        A run that is not a ``whole`` segment starts its key, so only its effect on "no state" matters.
        """

    def follow(self, state: State | None, effects: Iterator[State]) -> State:
        """State after a run with these effects; ``None`` is a key not seen before."""

    def scan(
        self, rows: dict[str, np.ndarray], starts: np.ndarray, state: State | None
    ) -> tuple[dict[str, Any], State]:
        """Outputs for one batch; ``starts`` marks the first row of each key, ``state`` enters the first row."""


def ordered_segments(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows sorted by (keys, order), written in segments, with their places."""
    spark, by = df.sparkSession, [*keys, *order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    rows = ranged.sortWithinPartitions(*by).withColumn(PLACE, F.monotonically_increasing_id()).withColumn(KEY, key_text(keys))
    path = scratch_path(spark, "segments")
    rows.write.option("maxRecordsPerFile", 1 << SEGMENT_BITS).option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def key_text(keys: list[str]) -> Column:
    """The key columns as one text that is never null; different keys have different texts."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")


def _key_changes(batch: pd.DataFrame) -> np.ndarray:
    """True where a row's key differs from the row above."""
    change = np.zeros(len(batch), dtype=bool)
    column = batch[KEY].to_numpy()
    change[1:] = column[1:] != column[:-1]
    return change


def _arrays(batch: pd.DataFrame, columns: list[str], since: int = 0) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy()[since:] for c in columns}


def _by_segment(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[tuple[int, bool, pd.DataFrame]]:
    """Parts of batches that lie in one segment, with its number and whether they begin it."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        places = batch[PLACE].to_numpy()
        cuts = np.flatnonzero(np.diff(places >> bits)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(batch)]):
            segment, first = int(places[begin] >> bits), int(places[begin])
            if segment != last and first & ((1 << bits) - 1):
                raise RuntimeError("a segment was read in parts: its rows take more than one row group")
            yield segment, segment != last, batch.iloc[begin:end]
            last = segment


def _summaries(fold: Fold, bits: int):
    """For each segment a row (part -1) for its first key, which may continue an earlier segment, and the effects of its last key."""

    def row(segment: int, key: str, part: int, whole: bool, effect: State) -> pd.DataFrame:
        return pd.DataFrame({SEGMENT: [segment], KEY: [key], "part": [part], "whole": [whole], "effect": [[float(x) for x in effect]]})

    def of(segment: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        whole, parts = True, []
        for batch in batches:
            changes = np.flatnonzero(_key_changes(batch))
            head = batch[KEY].iat[0]
            if first is None:
                first = head
            elif head != last:
                whole, parts = False, []
            since = 0
            if len(changes):
                whole, parts, since = False, [], int(changes[-1])
            parts.append(_arrays(batch, fold.inputs, since))
            last = batch[KEY].iat[len(batch) - 1]
        yield row(segment, first, -1, whole, [])
        for part, effect in enumerate(fold.effect(iter(parts), whole)):
            yield row(segment, last, part, whole, effect)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for segment, parts in groupby(_by_segment(batches, bits), key=lambda part: part[0]):
            yield from of(segment, (part[2] for part in parts))

    return run


def _chain(fold: Fold):
    """Summaries arrive by key and segment and are read as a stream; only the current state is kept.

    A segment asks for its first key's state before it tells what it does to its last key's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        state, known = None, None
        for (key, segment, asks), parts in groupby(rows, key=lambda row: (row[1], row[0], row[2] < 0)):
            if key != known:
                state, known = None, key
            if asks:
                if state is not None:
                    yield pd.DataFrame({SEGMENT: [segment], STATE: [state]})
                continue
            first = next(parts)
            effects = (list(row[4]) for row in _with_first(first, parts))
            state = fold.follow(state if first[3] else None, effects)

    return run


def _with_first(first, rest):
    yield first
    yield from rest


def _scan(fold: Fold, kept: list[str], bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, None
        for _, begins, batch in _by_segment(batches, bits):
            starts = _key_changes(batch)
            head = batch[KEY].iat[0]
            if begins:
                known = int(batch[ENTERING].iat[0])
                state = [float(batch[f"{STATE}{i}"].iat[0]) for i in range(known)] if known else None
            elif head != last:
                state = None
            starts[0] = state is None
            produced, state = fold.scan(_arrays(batch, fold.inputs), starts, state)
            last = batch[KEY].iat[len(batch) - 1]
            out = batch[kept].copy()
            for name, values in produced.items():
                out[name] = values
            yield out

    return run


def fold_segments(
    df: DataFrame, keys: list[str], order: list[str], fold: Fold, partitions: int | None = None
) -> DataFrame:
    """All columns of ``df`` plus the fold's outputs."""
    spark = df.sparkSession
    ship_package(spark)
    segments = ordered_segments(df, keys, order, partitions)
    needed = list(dict.fromkeys([PLACE, KEY, *fold.inputs]))
    summaries = segments.select(*needed).mapInPandas(_summaries(fold, SEGMENT_BITS), _SUMMARY)
    by_key = summaries.repartition(KEY).sortWithinPartitions(KEY, SEGMENT, "part")
    carry = by_key.mapInPandas(_chain(fold), _CARRY)
    # Plain columns: array columns are converted value by value on their way to Python.
    entering = [F.size(STATE).alias(ENTERING)] + [F.get(STATE, F.lit(i)).alias(f"{STATE}{i}") for i in range(fold.state_size)]
    kept = df.columns
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fold.outputs:
        schema = schema.add(name, kind)
    # One row of a few numbers for each segment, that is for a million rows.
    numbered = segments.withColumn(SEGMENT, F.shiftright(PLACE, SEGMENT_BITS))
    known = numbered.join(F.broadcast(carry.select(SEGMENT, *entering)), SEGMENT, "left")
    return known.fillna(0, [ENTERING]).mapInPandas(_scan(fold, kept, SEGMENT_BITS), schema)
