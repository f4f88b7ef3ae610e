"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm import words as W
from meterflow.llm.common import added_in_arrow, written
from meterflow.session import ship_package

#: Fourier features; they stand for a Gaussian kernel of this width over standardised statistics.
FEATURES, WIDTH, SEED = 256, 3.0, 11
RIDGE = 1e-3
#: Equally wide score bins that the calibration is fitted on, and the range they cover.
BINS, LOW, HIGH = 1000, -0.5, 1.5
#: Rows whose products are summed into one partial matrix, and partial matrices that one task adds up.
ROWS_PER_SUM, FAN_IN = 20_000, 16

STATISTICS = (
    "log_bytes log_words word_mean word_deviation word_longest spaces digits upper punctuation symbols beyond_ascii newlines "
    "distinct_words top_word same_as_last short_words line_mean distinct_lines entropy symbol_words"
).split()


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


_DIGIT, _UPPER = _table(b"0123456789"), _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PUNCTUATION, _SYMBOL = _table(b".,;:?'\"()-"), _table(b"!#$%&*+/<=>@[\\]^_`{|}~")
_NOT_NEWLINE = W.byte_class(without=b"\n")


def _statistics(text: np.ndarray, words: np.ndarray, lengths: np.ndarray, lines: np.ndarray, symbol_words: int) -> list[float]:
    n, k = max(len(text), 1), max(len(words), 1)
    byte_counts = np.bincount(text, minlength=256)
    share = byte_counts[byte_counts > 0] / n
    _, repeats = np.unique(words, return_counts=True)
    high = byte_counts[128:].sum()
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        lengths.mean() if len(lengths) else 0.0,
        lengths.std() if len(lengths) else 0.0,
        np.log1p(lengths.max()) if len(lengths) else 0.0,
        byte_counts[32] / n,
        byte_counts[_DIGIT].sum() / n,
        byte_counts[_UPPER].sum() / n,
        byte_counts[_PUNCTUATION].sum() / n,
        byte_counts[_SYMBOL].sum() / n,
        high / n,
        byte_counts[10] / n,
        len(repeats) / k,
        (repeats.max() if len(repeats) else 0) / k,
        (words[1:] == words[:-1]).sum() / k,
        (lengths <= 3).sum() / k,
        np.log1p(len(text) / max(len(lines), 1)),
        len(np.unique(lines)) / max(len(lines), 1),
        float(-(share * np.log2(share)).sum()),
        symbol_words / k,
    ]


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text of an Arrow column."""
    data, offsets = W.text_bytes(column)
    rows = []
    for i, j in W.groups_of(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, firsts = W.word_bounds(part, at, W.NOT_SPACE)
        values, lengths = W.word_hashes(part, starts, ends), ends - starts
        odd = np.concatenate(([0], np.cumsum(_SYMBOL[part[ends - 1]] if len(ends) else np.zeros(0, dtype=bool))))
        line_starts, line_ends, line_firsts = W.word_bounds(part, at, _NOT_NEWLINE)
        lines = W.word_hashes(part, line_starts, line_ends)
        for row in range(j - i):
            a, b = firsts[row], firsts[row + 1]
            own_lines = lines[line_firsts[row] : line_firsts[row + 1]]
            rows.append(_statistics(part[at[row] : at[row + 1]], values[a:b], lengths[a:b], own_lines, int(odd[b] - odd[a])))
    return np.array(rows, dtype=np.float64).reshape(-1, len(STATISTICS))


def document_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``statistics``, one array of doubles per document from its whole text; a null or empty text has fixed values too."""

    def compute(column: pa.Array) -> list[pa.Array]:
        found = statistics_of(column)
        starts = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS))
        return [pa.ListArray.from_arrays(starts, pa.array(found.reshape(-1)))]

    return added_in_arrow(docs, [text_col], [T.StructField("statistics", T.ArrayType(T.DoubleType()))], compute, keep)


@dataclass(frozen=True)
class Model:
    """All that a score needs; of fixed size, whatever the corpus."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, statistics: np.ndarray) -> np.ndarray:
        scaled = np.clip((statistics - self.mean) / self.deviation, -8, 8)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(waves), 1))])

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.fourier(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw score keeps the order within a level."""
        raw = np.clip(self.raw(statistics), LOW, HIGH)
        level = np.interp(raw, self.knots, self.values)
        if self.values[0] == self.values[-1]:  # nothing learnt: exactly that level
            return level
        return np.clip(0.999 * level + 0.001 * (raw - LOW) / (HIGH - LOW), 0.0, 1.0)


def _matrix(rows: DataFrame, column: str) -> np.ndarray:
    """An array column of a batch as a matrix."""
    return np.array(rows.column(column).flatten()).reshape(len(rows.column(column)), -1)


def _summed(parts: DataFrame, n: int) -> np.ndarray:
    """Add up partial matrices in rounds of ``FAN_IN`` each, so that no task and no driver holds more than that many."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=np.float64) for x in group.column("sums"))
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    while n > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(add, "part long, sums binary")
        n = -(-n // FAN_IN)
    row = parts.first()
    return np.frombuffer(row["sums"], dtype=np.float64)


def normal_equations(training: DataFrame, model: Model, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all training rows: one partial sum per partition, then sums of sums."""
    n_parts = max(1, -(-n_rows // ROWS_PER_SUM))
    size = len(model.phases) + 1

    def partial(batches):
        from pyspark import TaskContext

        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.fourier(_matrix(batch, "statistics"))
                total += z.T @ np.hstack([z, np.array(batch.column("label"), dtype=np.float64)[:, None]])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    parts = training.select("statistics", "label").repartition(n_parts).mapInArrow(partial, "part long, sums binary")
    total = _summed(parts, n_parts).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def isotonic(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence: neighbours that decrease are pooled."""
    pools: list[list[float]] = []
    for m, w in zip(mean, weight, strict=True):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, n2 = pools.pop()
            m1, w1, n1 = pools.pop()
            pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, m) for m, _, n in pools]) if pools else np.zeros(0)


def _raw_scores(rows: DataFrame, model: Model, name: str, calibrated: bool) -> DataFrame:
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list[pa.Array]:
        if not len(column):
            return [pa.array([], pa.float64())]
        statistics = np.array(column.flatten()).reshape(len(column), -1)
        return [pa.array(shared.value.score(statistics) if calibrated else shared.value.raw(statistics))]

    return added_in_arrow(rows, ["statistics"], [T.StructField(name, T.DoubleType())], compute, [c for c in rows.columns if c != "statistics"])


def fit(training: DataFrame, seed: int = SEED) -> Model:
    """Fit on ``id``, ``statistics`` and ``label`` (0 or 1) of all training rows.

    A quarter of them, by hash of the identifier, is left to the calibration: their raw scores are counted per bin
    and the bins' shares of label 1 are made non-decreasing. Without rows every score is one half; with one label only, that label's.
    """
    moments = [f(F.get("statistics", F.lit(k))) for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    found = training.agg(F.count("*"), F.avg("label"), *moments).first()
    random = np.random.default_rng(seed)
    directions = random.normal(0.0, 1.0 / WIDTH, (len(STATISTICS), FEATURES))
    phases = random.uniform(0.0, 2 * np.pi, FEATURES)
    constant = lambda level: Model(
        np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), directions, phases, np.zeros(FEATURES + 1), np.array([LOW, HIGH]), np.array([level, level])
    )
    if not found[0]:
        return constant(0.5)
    if found[1] in (0.0, 1.0):
        return constant(float(found[1]))
    mean, deviation = np.array(found[2::2], dtype=float), np.array(found[3::2], dtype=float)
    model = Model(mean, np.where(deviation > 1e-9, deviation, 1.0), directions, phases, np.zeros(0), np.zeros(0), np.zeros(0))
    calibrating = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("calibrate")), F.lit(4)) == 0
    fitted = training.where(~calibrating)
    gram, moment = normal_equations(fitted, model, int(found[0]))
    scale = np.trace(gram) / len(gram)
    weights = np.linalg.solve(gram + RIDGE * max(scale, 1e-12) * np.eye(len(gram)), moment)
    model = Model(model.mean, model.deviation, directions, phases, weights, np.zeros(0), np.zeros(0))
    raw = _raw_scores(training.where(calibrating), model, "raw", calibrated=False)
    bin_of = F.floor((F.least(F.greatest("raw", F.lit(LOW)), F.lit(HIGH)) - LOW) / (HIGH - LOW) * BINS).cast("int")
    bins = raw.groupBy(bin_of.alias("bin")).agg(F.count("*"), F.avg("label"), F.avg(F.least(F.greatest("raw", F.lit(LOW)), F.lit(HIGH)))).orderBy("bin").collect()
    if not bins:  # too few rows to calibrate on
        return Model(model.mean, model.deviation, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    levels = isotonic(np.array([b[2] for b in bins], dtype=float), np.array([b[1] for b in bins], dtype=float))
    return Model(model.mean, model.deviation, directions, phases, weights, np.array([b[3] for b in bins], dtype=float), levels)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows that no label is learnt from: the remainder 1 of the identifier's CRC."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(counted: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Model:
    """Fit on the labelled documents that are not held out, from a table of identifiers and statistics."""
    usable = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(label_col)).alias("label"))
    learnt = counted.where(~held_out(id_col)).select(F.col(id_col).alias("id"), "statistics").dropDuplicates(["id"]).join(usable, "id")
    return fit(written(learnt, "training"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every document.

    Only statistics of the whole text go into a score. Labels other than 0 and 1, and labels of held-out documents, are not used; a
    document with several labels counts with their mean, rounded. Null and empty texts are scored like others;
    repeated rows get equal scores; a document without identifier is scored, but not learnt from. Other columns are not read; an
    empty table gives an empty result.
    """
    counted = written(document_statistics(docs.select(id_col, text_col), text_col, [id_col]), "statistics")
    model = learn(counted, labels, id_col, label_col)
    scored = _raw_scores(counted.withColumn("held_out", held_out(id_col)), model, "score", calibrated=True)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(id_col, "held_out", "score", "predicted")


def filter_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; scores are as in ``score_quality``.

    The statistics are counted once more in the pass that carries the texts, which is cheaper than a shuffle of the texts.
    """
    counted = written(document_statistics(docs.select(id_col, text_col), text_col, [id_col]), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(learn(counted, labels, id_col, label_col))

    def compute(column: pa.Array) -> list[pa.Array]:
        return [pa.array(shared.value.score(statistics_of(column)))]

    return added_in_arrow(docs, [text_col], [T.StructField("_score", T.DoubleType())], compute).where(F.col("_score") >= threshold).drop("_score")
