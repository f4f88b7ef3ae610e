"""Phrase mining against plain counting; dense tiles, sparse coordinates, and the edge cases."""

import random
import re
from collections import Counter

import numpy as np

from meterflow.llm import phrases as P
from meterflow.llm import words as W

DOCS = "doc_id long, text string, lang string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def expected(rows, max_words=3, least=10, contained=50, top=2000):
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                count.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    known = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, g), a in known.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                around[lang, g[i : i + m]] = max(a, around[lang, g[i : i + m]])
    by_lang = {}
    for (lang, g), a in known.items():
        if 100 * around[lang, g] >= contained * a and around[lang, g]:
            continue
        cuts = [(10**6 * a * a // (count[lang, g[:k]] * count[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), count[lang, g[:k]], count[lang, g[k:]]))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    return sorted(map(tuple, P.mine_phrases(docs, **options).collect()))


def corpus():
    pick, rows = random.Random(7), []
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "漢字", "it's", "a-b", "x" * 5000]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    for k in range(300):
        words = pick.choices(vocabulary, weights, k=pick.randint(0, 80))
        text = "".join(w + pick.choice([" ", " ", " ", " \t", ", ", ".", "\n", "\r\n", "\x0b"]) for w in words)
        text += pick.choice(["", " New York City hall", " new york", " a a a a a"])
        rows.append((k, text, pick.choice(["en", "en", "de", None, "und", ""])))
    rows += [(900, None, "en"), (901, "", None), (902, " \t.,", "en"), (903, "lonely", "fr")] + [(904, "Of The people, by The people", "en")] * 12
    rows += [(905, " ".join(pick.choices([f"v{i}" for i in range(40)], k=60_000)), "es")]  # fills tiles
    return rows


def test_phrases_equal_plain_counts(spark):
    rows = corpus()
    assert found(spark, rows) == expected(rows)


def test_other_limits(spark):
    rows = [r for r in corpus() if r[0] != 905]
    for options in ({"max_words": 2, "least": 3}, {"max_words": 4, "least": 5, "contained": 80, "top": 7}, {"least": 1, "top": 50}):
        assert found(spark, rows, **options) == expected(rows, **options)


def test_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], DOCS)
    assert P.mine_phrases(empty).count() == 0
    docs = spark.createDataFrame([("x y. " * 20, "en", 1, 2, 3, 4)], "body string, language string, k1 int, n int, word int, text int")
    assert [tuple(r) for r in P.mine_phrases(docs, "body", "language").collect()] == [("en", 1, "x y", 20, 20, 20, 40, 10**6)]


def test_dense_tiles_and_coordinates_count_alike():
    pick = np.random.default_rng(5)
    keys = W.mix(np.arange(600, dtype=np.uint64))
    hashes = W.run_hashes(keys, 1)
    order = np.argsort(hashes)
    ranks = P.Ranks([keys], hashes[order], order)
    unranked = W.mix(np.arange(1000, 1010, dtype=np.uint64))
    words = np.concatenate([keys[(pick.random(60_000) ** 6 * 600).astype(int)], unranked])
    left, right = words[:-1], words[1:]
    at = [ranks.find(W.run_hashes(k, 1), [k]) for k in (left, right)]
    assert (at[0][:50] >= 0).all() and at[0][-1] == -1 and (ranks.keys[0][at[0][:-10]] == left[:-10]).all()
    tiles = P.Tiles(ranks, ranks)
    counted = tiles.add(*at)
    assert 10_000 < counted.sum() < len(left) - 100 and len(tiles.held) < 9
    total = Counter()
    for (x, y), n in tiles.emptied():
        total.update(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
    assert not tiles.held
    x, y = left[~counted], right[~counted]
    first, sizes = P._grouped([x, y], W.mix(x ^ (y << np.uint64(1))))
    for i, n in zip(first, sizes):
        total[int(x[i]), int(y[i])] += int(n)
    assert total == Counter(zip(left.tolist(), right.tolist()))


def test_equal_hashes_stay_apart():
    a, b = np.array([1, 2, 1, 2, 1], dtype=np.uint64), np.array([5, 5, 5, 6, 5], dtype=np.uint64)
    first, sizes = P._grouped([a, b], np.zeros(5, dtype=np.uint64))
    total = Counter()
    for i, n in zip(first, sizes):
        total[int(a[i]), int(b[i])] += int(n)
    assert total == {(1, 5): 3, (2, 5): 1, (2, 6): 1}
