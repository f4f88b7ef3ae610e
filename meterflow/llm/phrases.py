"""Phrase collocation mining by direct-address tiles over frequency-ranked identifiers.

Every word of a language has a 64-bit identifier, checked to be its own. Words are counted first; then phrases are
counted level by level, a phrase of n words as a pair of a phrase of n-1 words and a word:

* the most frequent words and, level by level, the most frequent shorter phrases are ranked anew. Their pairs fall into square tiles of
  ranks; a tile that a block of text fills well is counted with one dense ``bincount`` and kept until the task ends;
* pairs in other tiles, and pairs of unranked parts, are sorted and leave as coordinates with counts;
* both parts of a phrase (without its first and without its last word) must be frequent themselves. Whether they are is asked of a bitmap of
  fixed size; it may say yes too often, which costs time only.

What is broadcast (bitmap, ranked parts) has a fixed size whatever the corpus; all counts come from ordinary aggregations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm import words as W
from meterflow.llm.common import text_or_empty, written
from meterflow.session import ship_package

MAX_WORDS, LEAST, CONTAINED, TOP = 3, 10, 50, 2000
#: Parts that are ranked; ranks in a tile's side; pairs of one block from which a tile is counted densely; dense tiles held at a time.
RANKED, SIDE, DENSE, TILES = 1 << 16, 256, 1 << 13, 128
#: Bits of a bitmap, and bits of it in one row on its way to the driver.
BITS, SLICE = 1 << 25, 1 << 15
#: Bytes of text that are worked on at a time.
BLOCK = 4 << 20
UNKNOWN = "und"

BREAK = ~W.byte_class(without=b".,;:!?\n\x0b\x0c\r")
INSIDE = W.byte_class(without=b" \t.,;:!?\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _salts(langs: list[str], seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "little") for x in langs], dtype=np.uint64)


@dataclass
class Block:
    """The words of some texts in order."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lang: np.ndarray
    keys: np.ndarray
    joined: np.ndarray  # whether a word follows the one before it in the same piece


def _blocks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Block, list[str]]]:
    """Blocks of words of batches of ``text``, ``lang``, with the languages that ``lang`` numbers."""
    for batch in batches:
        data, offsets = W.text_bytes(batch.column(0))
        encoded = batch.column(1).dictionary_encode()
        langs, numbers = encoded.dictionary.to_pylist(), np.asarray(encoded.indices)
        salts = _salts(langs, seed)
        for i, j in W.groups_of(offsets, BLOCK):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, firsts = W.word_bounds(part, at, INSIDE)
            if not len(starts):
                continue
            lang = np.repeat(numbers[i:j], np.diff(firsts))
            keys = W.mix(W.word_hashes(part, starts, ends) + salts[lang])
            breaks = np.flatnonzero(BREAK[part])
            joined = np.ones(len(starts), dtype=bool)
            joined[firsts[:-1][firsts[:-1] < len(starts)]] = False
            joined[1:] &= np.searchsorted(breaks, ends[:-1]) == np.searchsorted(breaks, starts[1:])
            yield Block(part, starts, ends, lang, keys, joined), langs


def _grouped(columns: list[np.ndarray], order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and sizes of groups of equal columns. Equal rows that ``order_by`` interleaves with others may make several groups."""
    order = np.argsort(order_by, kind="stable")
    change = np.ones(len(order), dtype=bool)
    change[1:] = False
    for column in columns:
        ranked = column[order]
        change[1:] |= ranked[1:] != ranked[:-1]
    first = np.flatnonzero(change)
    return order[first], np.diff(np.append(first, len(order)))


def _texts(block: Block, at: np.ndarray) -> pa.Array:
    """The words at some positions, lower-cased."""
    sizes = block.ends[at] - block.starts[at]
    offsets = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    taken = LOWER[block.data[np.arange(offsets[-1]) + np.repeat(block.starts[at] - offsets[:-1], sizes)]]
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken)])


def _vocabulary(rows: DataFrame, seed: int) -> DataFrame:
    """``k1``, ``lang``, ``word``, ``n`` of every word."""

    def count(batches):
        for block, langs in _blocks(batches, seed):
            at, sizes = _grouped([block.keys], block.keys)
            arrays = [pa.array(block.keys[at].view(np.int64)), pa.array(langs, pa.string()).take(pa.array(block.lang[at])), _texts(block, at), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "lang", "word", "n"])

    return rows.mapInArrow(count, "k1 long, lang string, word string, n long").groupBy("k1", "lang", "word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str, lang_col: str) -> tuple[DataFrame, int]:
    """The counted words, with identifiers that no two words share, and the seed that gave them."""
    rows = _input(docs, text_col, lang_col)
    for seed in range(8):
        table = written(_vocabulary(rows, seed), "vocabulary")
        if table.groupBy("k1").agg(F.count("*").alias("words")).where(F.col("words") > 1).isEmpty():
            return table, seed
    raise RuntimeError("no seed gives every word an identifier of its own")


def _input(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))


def _keys(length: int) -> list[str]:
    return [f"k{i}" for i in range(1, length + 1)]


def _hashes_of(columns: list[np.ndarray]) -> np.ndarray:
    """The hash that ``run_hashes`` gives to the same keys in a row."""
    flat = np.stack(columns, axis=1).reshape(-1)
    return W.run_hashes(flat, len(columns))[:: len(columns)]


def _bitmap(frequent: DataFrame, length: int) -> np.ndarray:
    """The bitmap of frequent phrases: built in tasks, united by slices, at most ``BITS`` bits in the driver."""

    def mark(batches):
        bits = np.zeros(BITS, dtype=bool)
        for batch in batches:
            if batch.num_rows:
                columns = [np.asarray(c).view(np.uint64) for c in batch.columns]
                bits[(_hashes_of(columns) & np.uint64(BITS - 1)).astype(np.int64)] = True
        slices = bits.reshape(-1, SLICE)
        used = np.flatnonzero(slices.any(axis=1))
        packed = [np.packbits(slices[s], bitorder="little").tobytes() for s in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "bits"])

    rows = frequent.select(*_keys(length)).mapInArrow(mark, "slice int, bits binary").groupBy("slice").agg(F.bitmap_or_agg("bits").alias("bits")).collect()
    whole = np.zeros((BITS // SLICE, SLICE // 8), dtype=np.uint8)
    for at, packed in rows:
        whole[at] = np.frombuffer(packed, dtype=np.uint8)
    return whole.reshape(-1)


def _holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(BITS - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


@dataclass
class Ranks:
    """The most frequent parts: their keys by rank, and their ranks by hash."""

    keys: list[np.ndarray]
    hashes: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, frequent: DataFrame, length: int) -> Ranks:
        """At most ``RANKED`` parts: those from a count on, which a histogram in steps of a sixteenth of an octave gives."""
        step = F.floor(F.log2("n") * 16)
        room, least = RANKED, None
        for at, parts in sorted(frequent.groupBy(step.alias("at")).agg(F.count("*").alias("parts")).collect(), reverse=True):
            if parts > room:
                break
            room, least = room - parts, at
        top = [] if least is None else frequent.where(step >= least).select("n", *_keys(length)).collect()
        top = [r[1:] for r in sorted(top, key=lambda r: (-r[0], *r[1:]))]
        keys = [np.array([r[i] for r in top], dtype=np.int64).view(np.uint64) for i in range(length)]
        hashes = _hashes_of(keys) if top else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        return cls(keys, hashes[order], order)

    def find(self, hashes: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """The rank of each part, -1 if it has none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rank = self.rank[place]
        same = self.hashes[place] == hashes
        for own, given in zip(self.keys, keys, strict=True):
            same &= own[rank] == given
        return np.where(same, rank, -1)


class Tiles:
    """Dense counts of pairs of ranks, by tile."""

    def __init__(self, left: Ranks, right: Ranks):
        self.left, self.right, self.held = left, right, {}
        self.across = -(-max(len(right.rank), 1) // SIDE)

    def add(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Count what falls into well filled tiles; returns which pairs were counted."""
        ranked = (left >= 0) & (right >= 0)
        tile = np.where(ranked, (left // SIDE) * self.across + right // SIDE, 0)
        filled = np.bincount(tile[ranked], minlength=1)
        counted = np.zeros(len(left), dtype=bool)
        for t in np.flatnonzero(filled >= DENSE):
            inside = ranked & (tile == t)
            cells = np.bincount((left[inside] % SIDE) * SIDE + right[inside] % SIDE, minlength=SIDE * SIDE)
            self.held[t] = self.held[t] + cells if t in self.held else cells
            counted |= inside
        return counted

    def emptied(self) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Keys and counts of all tiles, which are cleared."""
        for t, cells in self.held.items():
            used = np.flatnonzero(cells)
            left = (t // self.across) * SIDE + used // SIDE
            right = (t % self.across) * SIDE + used % SIDE
            yield [*[k[left] for k in self.left.keys], self.right.keys[0][right]], cells[used]
        self.held = {}


def _level(rows: DataFrame, seed: int, length: int, bitmap: np.ndarray, shorter: Ranks, words: Ranks) -> DataFrame:
    """``k1`` ... and ``n`` of the phrases of a length whose parts are frequent."""
    shared = rows.sparkSession.sparkContext.broadcast((bitmap, shorter, words))
    names = _keys(length)

    def batch_of(keys: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(k.view(np.int64)) for k in keys], pa.array(n.astype(np.int64))], names=[*names, "n"])

    def count(batches):
        bits, left, right = shared.value
        tiles = Tiles(left, right)
        for block, _ in _blocks(batches, seed):
            parts = W.run_hashes(block.keys, length - 1)
            n = len(block.keys) - length + 1
            if n <= 0:
                continue
            good = _holds(bits, parts)
            good = good[:n] & good[1 : n + 1]
            for k in range(1, length):
                good &= block.joined[k : k + n]
            at = np.flatnonzero(good)
            keys = [block.keys[at + k] for k in range(length)]
            last = W.run_hashes(keys[-1], 1)
            counted = tiles.add(left.find(parts[at], keys[:-1]), right.find(last, keys[-1:]))
            keys, at = [k[~counted] for k in keys], at[~counted]
            if len(at):
                first, sizes = _grouped(keys, W.run_hashes(block.keys, length)[at])
                yield batch_of([k[first] for k in keys], sizes)
            if len(tiles.held) > TILES:
                for found in tiles.emptied():
                    yield batch_of(*found)
        for found in tiles.emptied():
            yield batch_of(*found)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in [*names, "n"]])
    return rows.mapInArrow(count, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The vocabulary (``k1``, ``lang``, ``word``, ``n``), and for each length the phrases (``k1`` ..., ``n``) that occur at least ``least`` times."""
    table, seed = vocabulary(docs, text_col, lang_col)
    rows = _input(docs, text_col, lang_col)
    levels = {1: written(table.where(F.col("n") >= least), "words")}
    words = shorter = Ranks.of(levels[1], 1)
    for length in range(2, max_words + 1):
        bitmap = _bitmap(levels[length - 1], length - 1)
        found = _level(rows, seed, length, bitmap, shorter, words)
        levels[length] = written(found.where(F.col("n") >= least), f"phrases-{length}")
        shorter = Ranks.of(levels[length], length)
    return table, levels


def _renamed(table: DataFrame, start: int, length: int, count: str) -> DataFrame:
    """A level's counts, to be joined to the words from ``start`` of longer phrases."""
    return table.select(*[F.col(f"k{i + 1}").alias(f"k{start + i}") for i in range(length)], F.col("n").alias(count))


def _scored(levels: dict[int, DataFrame], length: int) -> DataFrame:
    """Phrases of a length with ``a``, and ``l``, ``r``, ``score`` of their lowest-scoring cut."""
    rows = levels[length].withColumnRenamed("n", "a")
    cuts = []
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    for k in range(1, length):
        for start, size, name in ((1, k, f"l{k}"), (k + 1, length - k, f"r{k}")):
            part = _renamed(levels[size], start, size, name)
            rows = rows.join(part, [f"k{start + i}" for i in range(size)])
        rows = rows.withColumns({f"top{k}": F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a"), f"low{k}": exact(f"l{k}") * exact(f"r{k}")})
        score = F.expr(f"top{k} div low{k}")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return rows.withColumn("cut", best).select(*_keys(length), "a", "cut.l", "cut.r", "cut.score")


def _uncontained(rows: DataFrame, levels: dict[int, DataFrame], length: int, contained: int) -> DataFrame:
    """The phrases that no longer one contains which occurs at least ``contained`` per cent as often."""
    keys = _keys(length)
    inside = [
        table.select(*[F.col(f"k{start + i}").alias(f"k{i}") for i in range(1, length + 1)], F.col("n").alias("around"))
        for longer, table in levels.items()
        if longer > length
        for start in range(longer - length + 1)
    ]
    if not inside:
        return rows
    around = reduce(DataFrame.union, inside).groupBy(*keys).agg(F.max("around").alias("around"))
    kept = F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * contained)
    return rows.join(around, keys, "left").where(kept).drop("around")


def mine_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, contained: int = CONTAINED, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of each language by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line breaks, and these into words at spaces and tabs. Phrases have 2 to ``max_words``
    words of one piece and occur ``a`` times, at least ``least``. A cut into ``l`` first parts and ``r`` rests scores ``floor(1000000 a a / (l r))``; a
    phrase has the score of its lowest cut, the first of equal ones. Phrases inside a longer one with at least ``contained`` per cent
    of their count are dropped. Order: score, count, then the phrase in bytes. ``n`` is the number of words of the language.

    Null texts are empty, a null language is ``und``; equal rows count as often as they stand there. Counts up to 10^15 are exact. An empty table, and
    a language without such phrases, give no rows.
    """
    table, levels = phrase_counts(docs, text_col, lang_col, max_words, least)
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    found = []
    for length in range(2, max_words + 1):
        rows = _uncontained(_scored(levels, length), levels, length, contained)
        for k in range(1, length + 1):
            word = levels[1].select(F.col("k1").alias(f"k{k}"), F.col("word").alias(f"w{k}"), *(["lang"] if k == 1 else []))
            rows = rows.join(word, f"k{k}")
        found.append(rows.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(1, length + 1)]).alias("phrase"), "a", "l", "r", "score"))
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
