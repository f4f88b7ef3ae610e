"""Exact token counts at every word prefix of a text.

White space of ASCII always ends a word and never takes part in a token, so the tokens of a prefix are those of its words:
count[k] = count[k - 1] + tokens(word k). The right-hand term is the library's own answer for the single word, kept for the words
seen last; a text is never encoded as a whole, and no prefix is encoded again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm import words as W
from meterflow.llm.common import added_in_arrow

TOKENIZER = "word_bpe_49k.json"
#: Words whose counts a worker keeps, and the bytes up to which a word is kept.
KEPT_WORDS, KEPT_BYTES = 500_000, 64

COUNTS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
PREFIXES = [T.StructField("prefix_ends", T.ArrayType(T.IntegerType())), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))]


class WordCounts(dict):
    """Tokens of a word (as bytes): asked from the library once, then remembered while there is room."""

    def __init__(self, name: str):
        super().__init__()
        from public_tokenizers import path
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, word: bytes) -> int:
        n = len(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


_COUNTS: dict[str, WordCounts] = {}


def word_counts(name: str) -> WordCounts:
    if name not in _COUNTS:
        _COUNTS[name] = WordCounts(name)
    return _COUNTS[name]


def prefix_counts(text: bytes, counts: WordCounts) -> np.ndarray:
    """Tokens up to the end of each word of the text."""
    words = text.split()
    return np.cumsum(np.fromiter(map(counts.__getitem__, words), dtype=np.int64, count=len(words)))


def word_ends(text: bytes) -> np.ndarray:
    """Where each word of the text ends, in bytes."""
    data = np.frombuffer(text, dtype=np.uint8)
    return W.word_bounds(data, np.array([0, len(data)]), W.NOT_SPACE)[1]


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, prefixes: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_bytes`` and ``n_tokens``, and with ``prefixes`` the arrays ``prefix_ends`` and ``prefix_tokens``.

    ``prefix_tokens[k]`` is the exact number of tokens of the text's first ``prefix_ends[k]`` bytes, up to the end of
    its word k. Null and empty texts have no bytes, tokens or prefixes. Columns of the same names are replaced, repeated rows are
    counted each on their own, an empty table gives an empty result. ``tokenizer`` names a file of the public tokenizers, which every
    executor looks up for itself; its tokens must not reach over white space.
    """

    def compute(column: pa.Array) -> list[pa.Array]:
        counts = word_counts(tokenizer)
        data, offsets = W.text_bytes(column)
        totals = np.zeros(len(offsets) - 1, dtype=np.int64)
        ends, tokens = [], []
        for row in range(len(offsets) - 1):
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            sums = prefix_counts(text, counts)
            totals[row] = sums[-1] if len(sums) else 0
            if prefixes:
                ends.append(word_ends(text).astype(np.int32))
                tokens.append(sums.astype(np.int32))
        made = [pa.array(np.diff(offsets)), pa.array(totals)]
        return made + ([pa.array(ends, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))] if prefixes else [])

    return added_in_arrow(docs, [text_col], COUNTS + (PREFIXES if prefixes else []), compute, keep)


def fitting_words(limit: int | Column) -> Column:
    """How many words of a text with prefix counts fit into ``limit`` tokens: a look into the counts, nothing is encoded."""
    return F.size(F.filter("prefix_tokens", lambda n: n <= limit))


def truncated(limit: int | Column, text_col: str = "text") -> Column:
    """The longest prefix of whole words of at most ``limit`` tokens."""
    end = F.coalesce(F.get("prefix_ends", fitting_words(limit) - 1), F.lit(0))
    return F.when(F.col(text_col).isNotNull(), F.substring(F.encode(text_col, "UTF-8"), F.lit(1), end).cast("string"))


def tokens_between(first: int | Column, last: int | Column) -> Column:
    """Tokens of words ``first`` (from 0) up to, but without, ``last``; words beyond the end of the text have none."""

    def upto(k: int | Column) -> Column:
        place = F.least(F.lit(k) if isinstance(k, int) else k, F.size("prefix_tokens"))
        return F.coalesce(F.get("prefix_tokens", place - 1), F.lit(0))

    return upto(last) - upto(first)
