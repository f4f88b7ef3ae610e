"""Vectorised word and shingle hashing over Arrow text columns.

Texts are taken as UTF-8 bytes. Words are runs of bytes of a class, hashed as polynomials over random byte values;
nothing loops over bytes or words in Python. Work goes through blocks of bounded size, so a batch with very long texts
needs no more memory than its own bytes and a few arrays as long as one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes whose hash values are held at a time.
BLOCK_BYTES = 1 << 20

_GENERATOR = np.random.default_rng(20240229)
_WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE_BASE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))


def _byte_values() -> np.ndarray:
    values = _GENERATOR.integers(1, 2**63, 256, dtype=np.uint64)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


#: One random value per byte; A-Z count as a-z.
BYTE_VALUES = _byte_values()


def byte_class(allowed: str = "", *, without: bytes = b"", above_ascii: bool = True) -> np.ndarray:
    """Which bytes belong to words: those in ``allowed``, or, without it, all but ``without``."""
    table = np.zeros(256, dtype=bool) if allowed else np.ones(256, dtype=bool)
    if allowed:
        table[np.frombuffer(allowed.encode("ascii"), dtype=np.uint8)] = True
    table[np.frombuffer(without, dtype=np.uint8)] = False
    if allowed:
        table[128:] = above_ascii
    return table


#: ``[^\\x20\\x09-\\x0D]+``
NOT_SPACE = byte_class(without=b" \t\n\x0b\x0c\r")
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z
ALPHANUMERIC = byte_class("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[ends[0] : ends[-1]], ends.astype(np.int64) - int(ends[0])


def groups_of(offsets: np.ndarray, limit: int = 4 * BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together have at most ``limit`` bytes, or are a single row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every row the position of its first word (with one more at the end)."""
    inside = kind[data]
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # words end with their text
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        steps = np.full(size, _WORD_BASE, dtype=np.uint64)
        back = np.full(size, _INVERSE_BASE, dtype=np.uint64)
        steps[0] = back[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _POWERS, _INVERSES


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, alike for words that differ in the case of A-Z only."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")), i + 1)
        low = int(starts[i])
        if j == i + 1 and ends[i] - starts[i] > BLOCK_BYTES:  # one huge word: piece by piece
            total = np.uint64(0)
            with np.errstate(over="ignore"):
                for at in range(int(starts[i]), int(ends[i]), BLOCK_BYTES):
                    piece = data[at : min(at + BLOCK_BYTES, int(ends[i]))]
                    powers, _ = _powers(len(piece) + 1)
                    total = mix(np.array([total]))[0] + (BYTE_VALUES[piece] * powers[: len(piece)]).sum(dtype=np.uint64)
            out[i] = total
        else:
            piece = data[low : int(ends[j - 1])]
            powers, inverses = _powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES[piece] * powers[: len(piece)], out=sums[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[b] - sums[a]) * inverses[a]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` consecutive words, in order of the first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, length):
        out *= _SHINGLE_BASE
        out += words[k : k + n]
    return mix(out + np.uint64((length * 0x632BE59BD9B4E019) & (2**64 - 1)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted within the row, and each row's first position (with one more at the end).

    A row with fewer words than ``length``, but not none, has its whole sequence as its one shingle.
    """
    starts, ends, firsts = word_bounds(data, offsets, kind)
    words = word_hashes(data, starts, ends)
    runs = run_hashes(words, length)
    sets, rows = [], len(offsets) - 1
    for row in range(rows):
        a, b = int(firsts[row]), int(firsts[row + 1])
        if b - a >= length:
            sets.append(np.unique(runs[a : b - length + 1]))
        elif b > a:
            sets.append(run_hashes(words[a:b], b - a))
        else:
            sets.append(runs[:0])
    sizes = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=sizes[1:])
    return (np.concatenate(sets) if sets else runs[:0]), sizes
