"""Line dedup by content-defined chunks of lines.

A text is cut after a line when the rolling hash of that line and the one before it says so, around every long line, and
at its end. The cuts depend on the lines next to them only, so a passage that stands in several texts is cut alike in all of them
wherever it begins. Chunks of several lines, or of one long line, that occur more than once stay where they
come first.

Chunks miss short lines that end up alone and the ends of a passage. ``repeated_runs`` finds passages by their words instead: every
run of lines with over ``RUN_WORDS`` words is a union of shortest such runs, counted from each line forward and
backward, so a repeated one goes whole, from its first line to its last. ``dedup_lines(..., run_words=RUN_WORDS)`` takes out both.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm import words as W
from meterflow.llm.common import WORD, text_or_empty, unused, written
from meterflow.session import ship_package

#: Lines per chunk on average.
MEAN_LINES = 2
#: A line of so many code points is a passage of its own.
LONG_LINE = 250
#: Fixed values of the rolling hash over two lines: factor and modulus.
FACTOR, MODULUS = 1_000_003, 2_147_483_647
#: A run of lines with more words than this is a passage.
RUN_WORDS = 50
#: A text of which less than this share of its words would be left is a copy with edits; its remains would be fragments.
WHOLE_BELOW = 0.2
#: Odd factors of the two polynomials over line digests that stand for a run.
RUN_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column, mean_lines: int = MEAN_LINES, long_line: int = LONG_LINE) -> Column:
    """``array<struct<start, lines, text>>``: the chunks of a text, first line from 0; one empty chunk for an empty text."""

    def of(lines: Column) -> Column:
        marks = F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), (F.length(x) >= long_line).alias("long")))
        return F.transform(F.array(marks), lambda m: cut(lines, m))[0]

    def cut(lines: Column, marks: Column) -> Column:
        def begins(i: Column) -> Column:
            last, before = F.get(marks, i - 1), F.get(marks, i - 2)
            rolled = (F.when(i >= 2, before["h"]).otherwise(0) * FACTOR + last["h"]) % MODULUS
            return (i == 0) | last["long"] | F.get(marks, i)["long"] | (rolled % mean_lines == 0)

        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins)
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: chunk(lines, at, F.coalesce(F.get(s, k + 1), F.size(lines)))))[0]

    def chunk(lines: Column, start: Column, end: Column) -> Column:
        joined = F.array_join(F.slice(lines, start + 1, end - start), "\n")
        return F.struct(start.alias("start"), (end - start).alias("lines"), joined.alias("text"))

    return F.transform(F.array(F.split(text, "\n")), of)[0]


def repeatable(chunk: Column, long_line: int = LONG_LINE) -> Column:
    """Chunks that are removed where they repeat: several lines, or a long one, that are not blank."""
    return ((chunk["lines"] > 1) | (F.length(chunk["text"]) >= long_line)) & chunk["text"].rlike(r"[^\x20\x09-\x0D]")


def _nameless(id_col: str, text_col: str) -> Column:
    """What stands for a text without identifier, so that such rows are no group of their own; null for others."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_or_empty(text_col)))


def _name(text: Column) -> list[Column]:
    """What stands for a chunk in narrow rows."""
    return [F.xxhash64(text).alias("hash"), F.unhex(F.md5(text)).alias("check")]


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """``id``, ``none``, ``start``, ``lines``, ``hash`` of every chunk that has come before, by identifier and line; ``none`` tells texts without identifier apart.

    Grouping by the chunk's own text is the comparison of bytes; copies of a chunk in one task shrink to one row before the shuffle. Should two
    texts ever share both hashes, neither is removed, for the rows that follow carry the hashes only.
    """
    chunks = F.filter(chunks_of(text_or_empty(text_col), mean_lines, long_line), lambda c: repeatable(c, long_line))
    rows = docs.select(F.col(id_col).alias("id"), _nameless(id_col, text_col).alias("none"), F.explode(chunks).alias("c")).select("id", "none", "c.start", "c.lines", "c.text")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("start").alias("start"))
    same = rows.groupBy("text").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    known = same.where(F.col("n") > 1).select(*_name(F.col("text")), "first")
    known = known.groupBy("hash", "check").agg(F.min("first").alias("first"), F.count("*").alias("texts")).where(F.col("texts") == 1)
    narrow = rows.select("id", "none", "start", "lines", *_name(F.col("text")))
    # written, so that both sides of the join are plain exchanges: the rows of a very common chunk can be split then
    later = narrow.join(written(known.drop("texts"), "known-chunks"), ["hash", "check"]).where(place != F.col("first"))
    return later.select("id", "none", "start", "lines", "hash")


def run_bounds(words: np.ndarray, firsts: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines and ends of the shortest runs of over ``run_words`` words from each line forward and backward, each run once.

    ``words`` are the words of all lines, ``firsts`` where each text's lines begin, with one more at the end.
    """
    n = len(words)
    total, line = np.concatenate([[0], np.cumsum(words)]), np.arange(n)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    ends = np.searchsorted(total, total[:-1] + run_words, side="right")
    starts = np.searchsorted(total, total[1:] - run_words, side="left") - 1
    forward, backward = ends <= firsts[1:][text], starts >= firsts[:-1][text]
    runs = np.unique(np.concatenate([line[forward] * (n + 1) + ends[forward], starts[backward] * (n + 1) + line[backward] + 1]))
    return runs // (n + 1), runs % (n + 1)


def _powers(factor: int, n: int) -> np.ndarray:
    steps = np.full(n, factor, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _runs(texts: list[bytes], run_words: int) -> tuple[np.ndarray, ...]:
    """Text, first line, lines and two hashes of every shortest run, and of every whole text that has words."""
    split = [t.split(b"\n") for t in texts]
    lines = [x for parts in split for x in parts]
    firsts = np.concatenate([[0], np.cumsum([len(parts) for parts in split])])
    words = np.array([len(x.split()) for x in lines])
    start, end = run_bounds(words, firsts, run_words)
    total = np.add.reduceat(words, firsts[:-1]) if len(texts) else words
    short = np.flatnonzero((total > 0) & (total <= run_words))
    start, end = np.concatenate([start, firsts[short]]), np.concatenate([end, firsts[short + 1]])
    digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in lines), dtype="<u8").reshape(-1, 2)
    hashes = []
    for k, factor in enumerate(RUN_FACTORS):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(digests[:, k] * _powers(factor, len(lines)), dtype=np.uint64)])
        back = _powers(pow(factor, -1, 1 << 64), len(lines))
        hashes.append(W.mix((sums[end] - sums[start]) * back[start]).view(np.int64))
    text = np.searchsorted(firsts, start, side="right") - 1
    return text, (start - firsts[text]).astype(np.int32), (end - start).astype(np.int32), *hashes


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """``id``, ``none``, ``start``, ``lines``, ``hash`` of every shortest run that has come before, by identifier and line; ``hash`` is the text's.

    A text of fewer words is one run, so a copy of it goes whole too. Runs are the same if two 64-bit hashes and the number of lines are. A run that overlaps its first occurrence is no repetition.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), "text", F.when(F.col("id").isNull(), F.xxhash64("text")).alias("none"))
    fields = ["start", "lines", "h1", "h2"]

    def find(batches):
        for batch in batches:
            _, offsets = W.text_bytes(batch.column(2))
            for i, j in W.groups_of(offsets):
                texts = [t.encode() for t in batch.column(2).slice(i, j - i).to_pylist()]
                text, *found = _runs(texts, run_words)
                if len(text):
                    at = pa.array(text + i)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in (0, 1, 3)], *map(pa.array, found)], names=["id", "hash", "none", *fields])

    ship_package(docs.sparkSession)
    kinds = [T.IntegerType(), T.IntegerType(), T.LongType(), T.LongType()]
    schema = T.StructType([rows.schema["id"], T.StructField("hash", T.LongType()), T.StructField("none", T.LongType()), *map(T.StructField, fields, kinds)])
    runs = rows.mapInArrow(find, schema)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("start").alias("start"))
    same = runs.groupBy("h1", "h2", "lines").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    known = written(same.where(F.col("n") > 1).drop("n"), "known-runs")
    apart = (~F.col("id").eqNullSafe(F.col("first.id"))) | (F.col("start") >= F.col("first.start") + F.col("lines"))
    return runs.join(known, ["h1", "h2", "lines"]).where(apart).select("id", "none", "start", "lines", "hash")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES, long_line: int = LONG_LINE, run_words: int | None = None) -> DataFrame:
    """The documents with repeated chunks taken out of ``text_col``, and ``n_lines``, ``n_removed_lines``.

    With ``run_words`` repeated runs of lines of more words go as well, whole.

    All other columns stay; columns of the two new names are replaced. A null text stays null and has no lines, an empty text is one
    empty line; a text may become empty. Within a document too, a chunk stays where it comes first. Equal rows of one
    identifier are one document and keep equal texts; rows without identifier come last. An empty table gives an empty result.
    """
    found, remains, lines = _cut(docs.drop("n_lines", "n_removed_lines"), id_col, text_col, mean_lines, long_line, run_words)
    text, left = F.col(text_col), F.col(remains)
    removed = F.when(left.isNull(), 0).otherwise(F.col(lines) - F.size(left)).cast("long")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return found.select(*[F.when(left.isNull(), text).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else c for c in columns], F.col(lines).alias("n_lines"), removed.alias("n_removed_lines"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", run_words: int = RUN_WORDS, whole_below: float = WHOLE_BELOW
) -> DataFrame:
    """The documents with repeated chunks, repeated runs and copies of whole texts taken out; ``chars_col`` follows the text.

    Documents of which no word is left go. Those of which a share of words below ``whole_below`` would be left stay whole: they are copies of
    others with edits, which near dedup recognises by their whole texts but not by fragments of them. Rows, columns and edge cases otherwise as in
    ``dedup_lines``; documents without words stay unless they lost some.
    """
    found, remains, _ = _cut(docs, id_col, text_col, MEAN_LINES, LONG_LINE, run_words)
    cut, held = unused(found.columns, "cut", "held")
    words = lambda c: F.regexp_count(c, F.lit(WORD))
    rows = found.withColumn(cut, F.when(F.col(remains).isNotNull(), F.array_join(remains, "\n")))
    rows = rows.withColumn(held, F.when(F.col(cut).isNotNull(), words(F.col(cut)))).where(F.col(held).isNull() | (F.col(held) > 0))
    cuts = F.col(held) >= words(F.col(text_col)) * F.lit(whole_below)
    made = {text_col: F.when(cuts, F.col(cut)).otherwise(F.col(text_col)), chars_col: F.when(cuts, F.length(cut).cast("long")).otherwise(F.col(chars_col))}
    return rows.select(*[made[c].alias(c) if c in made else c for c in docs.columns])


def _cut(docs: DataFrame, id_col: str, text_col: str, mean_lines: int, long_line: int, run_words: int | None) -> tuple[DataFrame, str, str]:
    """The documents with two more columns, whose names are returned: the lines that remain where any are removed, and the number of all lines."""
    gone = repeated_chunks(docs, id_col, text_col, mean_lines, long_line).withColumn("run", F.lit(False))
    if run_words is not None:
        gone = gone.unionByName(repeated_runs(docs, id_col, text_col, run_words).withColumn("run", F.lit(True)))
    of, none, parts, remains, number = unused([*docs.columns, "n_lines", "n_removed_lines"], "of", "none", "parts", "remains", "lines")
    gone = written(gone, "repeated-chunks").groupBy(F.col("id").alias(of), F.col("none").alias(none)).agg(F.collect_set(F.struct("start", "lines", "hash", "run")).alias(parts))
    # the list grows with the corpus: a sort-merge join whatever its size
    rows = docs.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(of)) & _nameless(id_col, text_col).eqNullSafe(F.col(none)), "left")
    text = F.col(text_col)

    def stays(lines: Column) -> Column:
        """The lines outside the chunks and runs to remove; they count only if they stand there in this very text."""
        own = lambda g: F.xxhash64(F.array_join(F.slice(lines, g["start"] + 1, g["lines"]), "\n"))
        real = F.filter(parts, lambda g: F.when(g["run"], F.xxhash64(text)).otherwise(own(g)) == g["hash"])
        numbers = F.flatten(F.transform(real, lambda g: F.sequence(g["start"], g["start"] + g["lines"] - 1)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
        return F.transform(kept, lambda i: F.get(lines, i))

    left = F.transform(F.array(F.split(text, "\n")), stays)[0]
    total = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    found = rows.withColumns({remains: F.when(F.col(parts).isNotNull() & text.isNotNull(), left), number: total.cast("long")})
    return found.drop(of, none, parts), remains, number
