"""Small tables with what real ones bring: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int) -> str:
    pick = random.Random(seed)
    made = ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 8))) for _ in range(400)]
    return " ".join(pick.choice(made) for _ in range(n))


def frame(spark, texts, source="s"):
    """One document per text, or per (identifier, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", source, len(t) if t is not None else None) for i, t in rows], DOC)


def rows_of(result) -> list[tuple]:
    return sorted(map(tuple, result.collect()), key=str)
