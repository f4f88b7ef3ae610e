"""Licence scans: normalised passages are compared to licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import lower_ascii, text_or_empty

THRESHOLD = 0.8

# Wordings by which works state their licence, as their publishers give them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "BSD-3-Clause": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}


def plain_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


@dataclass(frozen=True)
class Template:
    """A wording as its set of word bigrams. ``low`` and ``high`` bound the number of bigrams of a passage that can reach the threshold."""

    licence: str
    number: int
    bigrams: tuple[str, ...]
    low: int
    high: int
    anchors: frozenset[str]


def template(licence: str, number: int, text: str, threshold: float = THRESHOLD) -> Template:
    """``anchors`` is a set of words of which every passage that reaches the threshold has one.

    A passage of n bigrams reaches it with at least threshold * (n + t) / 2 of the t bigrams of the template, and n is at
    least the lower bound; so it has one of any t - least + 1 bigrams. Words are added, those first that
    stand in many bigrams for their length, until that many bigrams have an anchor.
    """
    words = plain_words(text)
    bigrams = tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
    t = len(bigrams)
    low, high = math.ceil(t * threshold / (2 - threshold) - 1e-9), math.floor(t * (2 - threshold) / threshold + 1e-9)
    least = math.ceil(threshold * (low + t) / 2 - 1e-9)
    anchors: set[str] = set()
    open_ = set(bigrams)
    while t - len(open_) < t - least + 1 and open_:
        found: dict[str, int] = {}
        for pair in open_:
            for word in set(pair.split()):
                found[word] = found.get(word, 0) + 1
        best = max(sorted(found), key=lambda w: found[w] * len(w) ** 2)
        anchors.add(best)
        open_ = {pair for pair in open_ if best not in pair.split()}
    return Template(licence, number, bigrams, low, high, frozenset(anchors))


def templates(threshold: float = THRESHOLD, texts: dict[str, list[str]] | None = None) -> list[Template]:
    wanted = TEMPLATES if texts is None else texts
    return [template(name, i, text, threshold) for name, all_ in wanted.items() for i, text in enumerate(all_)]


def normalised(text: Column) -> Column:
    """Words of a-z and 0-9 with single spaces between them."""
    return F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " "))


def bigrams_of(norm: Column) -> Column:
    """The distinct word bigrams of a normalised passage; none for less than two words."""
    return F.transform(
        F.array(F.split(norm, " ")),
        lambda w: F.array_distinct(
            F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        ),
    )[0]


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: frozenset[str] | None = None) -> DataFrame:
    """``id``, ``passage`` and ``norm`` for every line, and for every block of several lines between blank ones.

    With ``anchors``, only passages that have one of these words.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    lines = F.split("text", "\n")
    blocks = F.filter(F.split("text", r"\n(?:[\x20\t\r]*+\n)++"), lambda x: x.contains("\n"))
    if anchors is None:
        found = rows.select("id", F.explode(F.concat(lines, blocks)).alias("passage"))
    else:
        has = lambda x: lower_ascii(x).rlike(f"(?<![a-z0-9])(?:{'|'.join(sorted(anchors))})(?![a-z0-9])")
        found = rows.where(has(F.col("text"))).select("id", F.explode(F.concat(lines, blocks)).alias("passage")).where(has(F.col("passage")))
    return found.select("id", "passage", normalised(F.col("passage")).alias("norm"))


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, texts: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per passage and licence that reaches the threshold: ``id``, ``passage``, ``licence``, ``dice``.

    Whole texts are cut into passages: every line, and every block of several lines between blank lines. Templates whose
    size bounds exclude a passage are not compared with it, and passages with none of the words that a match cannot lack
    are left out before; neither loses a match. Of a licence's wordings the closest counts. Null and empty texts have no
    passages; a passage that a document repeats is reported each time, as are repeated rows; an empty table gives an empty result.
    """
    wanted = templates(threshold, texts)
    anchors = frozenset().union(*(t.anchors for t in wanted))
    rows = passages(docs, id_col, text_col, anchors).withColumn("pairs", bigrams_of(F.col("norm")))
    n = F.size("pairs")

    def dice(t: Template) -> Column:
        shared = F.size(F.array_intersect("pairs", F.array(*map(F.lit, t.bigrams))))
        return F.when(n.between(t.low, t.high), F.lit(2.0) * shared / (n + len(t.bigrams)))

    by_licence: dict[str, list[Column]] = {}
    for t in wanted:
        by_licence.setdefault(t.licence, []).append(dice(t))
    best = [
        F.struct(F.lit(name).alias("licence"), (F.greatest(*found) if len(found) > 1 else found[0]).alias("dice")) for name, found in by_licence.items()
    ]
    matches = F.filter(F.array(*best), lambda x: x["dice"] >= threshold)
    return rows.select("id", "passage", F.explode(matches).alias("m")).select("id", "passage", "m.licence", "m.dice")


def document_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and licence found in it: ``id``, ``licence``, ``n_passages``, ``best_dice``."""
    found = scan_licences(docs, id_col, text_col, threshold)
    return found.groupBy("id", "licence").agg(F.count("*").alias("n_passages"), F.max("dice").alias("best_dice"))
