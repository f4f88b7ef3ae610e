"""Benchmark decontamination: word windows of benchmark items are looked for in all windows of the documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm import words as W
from meterflow.llm.common import added_in_arrow, text_or_empty, unused, written
from meterflow.session import ship_package

WINDOW = 10
#: Up to so many bytes of benchmark text are broadcast as an index; a larger benchmark is joined by window hash instead.
BROADCAST_BYTES = 2 << 20

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
WINDOW_SCHEMA = "item string, length int, hash long, words string"


@dataclass
class Index:
    """Windows by hash: ``hashes`` sorted per length, and for each the items and the words it stands for."""

    hashes: dict[int, np.ndarray]
    bits: dict[int, np.ndarray]
    entries: dict[tuple[int, int], list[tuple[bytes, str]]]

    @classmethod
    def of(cls, windows: list[tuple[str, int, int, str]]) -> Index:
        entries: dict[tuple[int, int], list[tuple[bytes, str]]] = {}
        for item, length, value, text in windows:
            entries.setdefault((length, value & (2**64 - 1)), []).append((text.encode(), item))
        hashes = {n: np.unique(np.array([v for k, v in entries if k == n], dtype=np.uint64)) for n in {k for k, _ in entries}}
        bits = {}
        for n, values in hashes.items():
            size = 1 << max(16, int(64 * len(values)).bit_length())
            bits[n] = np.zeros(size, dtype=bool)
            bits[n][(values & np.uint64(size - 1)).astype(np.int64)] = True
        return cls(hashes, bits, entries)

    def probable(self, length: int, runs: np.ndarray) -> np.ndarray:
        """Positions of runs whose hash is that of a window."""
        near = np.flatnonzero(self.bits[length][(runs & np.uint64(len(self.bits[length]) - 1)).astype(np.int64)])
        return near[np.isin(runs[near], self.hashes[length])]


def _window_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, length: int) -> bytes:
    return b" ".join(data[starts[k] : ends[k]].tobytes().lower() for k in range(first, first + length))


def scan(data: np.ndarray, offsets: np.ndarray, index: Index, out: tuple[list, list, list, list]) -> None:
    """Append the number of words, of hit words, the items and the hit spans (code points) of every row."""
    starts, ends, firsts = W.word_bounds(data, offsets, W.ALPHANUMERIC)
    values = W.word_hashes(data, starts, ends)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    covered: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for length in index.hashes:
        runs = W.run_hashes(values, length)
        at = index.probable(length, runs)
        at = at[row_of[at] == row_of[at + length - 1]]
        for first in at.tolist():
            text = _window_text(data, starts, ends, first, length)
            found = [item for words, item in index.entries[length, int(runs[first])] if words == text]
            if found:
                row = int(row_of[first])
                covered.setdefault(row, []).append((first, first + length))
                items.setdefault(row, set()).update(found)
    for row in range(len(offsets) - 1):
        out[0].append(int(firsts[row + 1] - firsts[row]))
        joined: list[list[int]] = []
        for a, b in sorted(covered.get(row, ())):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        out[1].append(sum(b - a for a, b in joined))
        out[2].append(sorted(items.get(row, ())))
        spans = []
        if joined:
            begin = int(offsets[row])
            letters = np.cumsum((data[begin : int(offsets[row + 1])] & 0xC0) != 0x80)  # code points up to and with each byte
            spans = [{"start": int(letters[starts[a] - begin]) - 1, "end": int(letters[ends[b - 1] - 1 - begin])} for a, b in joined]
        out[3].append(spans)


def _arrays(out: tuple[list, list, list, list]) -> list[pa.Array]:
    return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], _SPANS)]


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item``, ``length``, ``hash``, ``words`` of every window of every item; a shorter item, but not an empty one, is one window."""

    def run(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            starts, ends, firsts = W.word_bounds(data, offsets, W.ALPHANUMERIC)
            values = W.word_hashes(data, starts, ends)
            found: list[tuple] = []
            for row, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(firsts[row]), int(firsts[row + 1])
                n = min(window, b - a)
                for k, value in enumerate(W.run_hashes(values[a:b], n).view(np.int64).tolist() if n else ()):
                    found.append((item, n, value, _window_text(data, starts, ends, a + k, n).decode()))
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item", "length", "hash", "words"])

    ship_package(benchmark.sparkSession)
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, WINDOW_SCHEMA)


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    keep: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted) and ``spans`` (of hit words, in code points, end exclusive) to the documents.

    A window is ``window`` consecutive words of an item. Every window of every whole text is looked up by hash and compared word
    by word when the hash is known; words inside any occurrence are hit, and adjacent hits form one span. Null and empty texts have no words, items
    without words are never found, an item without identifier goes by the empty name, repeated items count once.
    Columns of the same names are replaced. The benchmark is broadcast if it has at most ``broadcast_bytes`` bytes of text; otherwise
    the windows of the documents are joined with those of the benchmark, and each document is scanned for the windows that it shares.
    """
    spark = docs.sparkSession
    n_bytes = benchmark.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    if n_bytes > broadcast_bytes:
        return _by_join(docs, benchmark, id_col, text_col, item_col, window, keep)
    rows = benchmark_windows(benchmark, item_col, "text", window).distinct().collect()
    shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
    state: dict[str, Index] = {}

    def compute(column: pa.Array) -> list[pa.Array]:
        index = state.get("index")
        if index is None:
            index = state["index"] = Index.of(shared.value)
        data, offsets = W.text_bytes(column)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, j in W.groups_of(offsets):
            scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], index, out)
        return _arrays(out)

    return added_in_arrow(docs, [text_col], FIELDS, compute, keep)


def _document_windows(docs: DataFrame, id_col: str, text_col: str, lengths: list[int]) -> DataFrame:
    """``id``, ``check`` (hash of the text), ``length``, ``hash`` of the distinct windows of each document."""

    def run(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for i, j in W.groups_of(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, firsts = W.word_bounds(part, at, W.ALPHANUMERIC)
                values = W.word_hashes(part, starts, ends)
                row_of = np.repeat(np.arange(j - i), np.diff(firsts))
                for length in lengths:
                    runs = W.run_hashes(values, length)
                    good = np.flatnonzero(row_of[: len(runs)] == row_of[length - 1 :][: len(runs)])
                    at = pa.array(row_of[good] + i)
                    arrays = [batch.column(0).take(at), batch.column(2).take(at), pa.array(np.full(len(good), length, dtype=np.int32)), pa.array(runs[good].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "check", "length", "hash"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("check"))
    schema = T.StructType([rows.schema["id"], rows.schema["check"], T.StructField("length", T.IntegerType()), T.StructField("hash", T.LongType())])
    return rows.mapInArrow(run, schema).distinct()


def _by_join(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, window: int, keep: list[str] | None) -> DataFrame:
    windows = written(benchmark_windows(benchmark, item_col, "text", window).distinct(), "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``window`` values
    known = windows.select("length", "hash").distinct()
    held = _document_windows(docs, id_col, text_col, lengths).join(known, ["length", "hash"], "left_semi")
    entry = F.struct("item", "length", "hash", "words")
    of, same, found = unused([*docs.columns, *[f.name for f in FIELDS]], "of", "same", "found")
    shared = held.join(windows, ["length", "hash"]).groupBy(F.col("id").alias(of), F.col("check").alias(same)).agg(F.collect_list(entry).alias(found))
    on = F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_or_empty(text_col)) == F.col(same))
    rows = docs.join(shared.hint("merge"), on, "left").drop(of, same)

    def compute(column: pa.Array, lists: pa.Array) -> list[pa.Array]:
        data, offsets = W.text_bytes(column)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for row, found in enumerate(lists):
            index = Index.of([(w["item"], w["length"], w["hash"], w["words"]) for w in found.as_py() or ()])
            scan(data[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]), index, out)
        return _arrays(out)

    return added_in_arrow(rows, [text_col, found], FIELDS, compute, keep or docs.columns)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, remove: str = "documents"
) -> DataFrame:
    """The documents without those that hold a benchmark window (``remove="documents"``) or without the hit spans (``"spans"``)."""
    found = find_hits(docs, benchmark, id_col, text_col, item_col, window)
    if remove == "documents":
        return found.where(F.col("n_hit") == 0).select(*docs.columns)
    text = F.col(text_col)
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
    cut = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(text)
    return found.withColumn(text_col, cut).select(*docs.columns)
