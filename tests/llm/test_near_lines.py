"""Near-dedup against all pairs; line dedup against a plain reading of its rules."""

import hashlib
import random

from helpers import frame, prose, rows_of
from pyspark.sql import functions as F

from meterflow.llm import lines, neardup


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def expected_components(texts, similarity=85):
    sets = [(i, shingles(t)) for i, t in texts]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def edited(words, n, seed):
    pick, out = random.Random(seed), list(words)
    for k in pick.sample(range(len(out)), n):
        out[k] = f"new{seed}x{k}"
    return out


def near_texts():
    texts, base = [], prose(170, 1).split()
    for k in range(90):  # a crowded group: copies with few and with many edits
        texts.append(" ".join(edited(base, k % 9, 100 + k)))
    chain = prose(120, 2).split()
    for k in range(12):  # each like the next one, the ends unlike each other
        chain = edited(chain, 1, 500 + k)
        texts.append(" ".join(chain))
    texts += [" ".join(base).upper(), "a b c", "A B C", "a b c d", "", None, " \n\t ", "x" * 3_000_000, prose(20_000, 3), prose(20_000, 3) + " end"]
    texts += [prose(60, 10 + k) for k in range(40)]
    texts += ["same five words right here"] * 30
    return list(enumerate(texts, start=1000))


def test_components_equal_all_pairs(spark):
    texts = near_texts()
    shuffled = random.Random(5).sample(texts, len(texts))
    found = [(r.id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, shuffled)).collect()]
    assert sorted(found) == expected_components(texts)


def test_pairs_that_straddle_a_crowd(spark):
    """A passage that several hundred texts share crowds entries of the index; an edit takes one end of a pair out of them."""
    passage, texts = prose(55, 8000).split(), []
    for k in range(400):
        own = prose(75, 8001 + k).split()
        at = random.Random(k).randrange(55)
        texts += [" ".join(passage + own), " ".join([*passage[:at], f"edit{k}", *passage[at + 1 :], *own])]
    texts = list(enumerate(texts))
    found = [(r.id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, texts)).collect()]
    assert sorted(found) == expected_components(texts)


def test_near_edges(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "q w e r t y"), (1, "q w e r t y"), (None, "q w e r t y"), (None, None), (3, None), (4, "Q w e r t y")])
    found = rows_of(neardup.near_duplicates(docs))
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (None, 0, None, True), (3, 0, 3, True), (4, 2, 1, False)], key=str)
    kept = neardup.dedup_near(docs.withColumnRenamed("source", "id"))
    assert kept.count() == 5 and "id" in kept.columns


def test_texts_of_one_identifier_are_one_document(spark):
    a, b = prose(80, 21), prose(80, 22)
    a2, b2 = a + " more", b + " more"
    found = lambda texts: sorted((r.id, r.component_id) for r in neardup.near_duplicates(frame(spark, texts)).collect())
    assert found([(1, a), (1, b), (2, a2), (3, b2), (4, "")]) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert found([(5, a), (5, b), (2, a2), (3, b2), (9, a)]) == [(2, 2), (3, 2), (5, 2), (5, 2), (9, 2)]
    assert found([(7, a), (7, b), (7, ""), (8, b2 + " x"), (6, b2)]) == [(6, 6), (7, 6), (7, 6), (7, 7), (8, 6)]


def test_columns_in_the_way(spark):
    docs = frame(spark, [(1, prose(60, 1)), (2, prose(60, 1)), (3, prose(60, 2))])
    names = "of _of near_copy _near_copy none _none parts remains lines cut held start id check n_lines n_removed_lines".split()
    more = docs.select("*", *[F.lit(7).alias(n) for n in names])
    for left in (neardup.dedup_near(more), lines.without_repeats(more)):
        assert left.columns == more.columns and sorted(r.doc_id for r in left.where("none = 7 and n_lines = 7").collect()) == [1, 3]
    assert lines.dedup_lines(more).count() == 3


def test_many_rows_without_identifier(spark):
    body = "\n".join(prose(12, k) for k in range(6))
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("own "), (F.col("id") % 50_000).cast("string")).alias("text"))
    named = spark.createDataFrame([(1, body), (None, body)], "doc_id long, text string")
    left = lines.without_repeats(rows.union(named), chars_col="none_such")
    assert left.count() == 100_001 and left.where(F.col("text") == body).first().doc_id == 1


def test_copies_with_edits_stay_whole_and_others_are_cut(spark):
    body = [prose(9, 600 + k) for k in range(12)]
    near, quoting, short = [*body[:5], body[5] + " edited", *body[6:]], [prose(9, 700 + k) for k in range(12)] + body, "four words are here"
    texts = [(1, "\n".join(body)), (2, "\n".join(near)), (3, "\n".join(quoting)), (4, "\n".join(body)), (5, short), (6, short), (7, ""), (8, None)]
    left = {r.doc_id: (r.text, r.n_chars) for r in lines.without_repeats(frame(spark, texts)).collect()}
    own = "\n".join(quoting[:12])
    assert left == {1: (texts[0][1], len(texts[0][1])), 2: (texts[1][1], len(texts[1][1])), 3: (own, len(own)), 5: (short, len(short)), 7: ("", 0), 8: (None, None)}


def test_index_holds_every_pair_within_the_distance():
    """Any two signatures of 32 values that differ in at most DISTANCE have a chunk with at most one difference."""
    assert neardup.DISTANCE < 2 * neardup.CHUNKS
    pick = random.Random(3)
    for _ in range(2000):
        wrong = pick.sample(range(32), neardup.DISTANCE)
        assert min(sum(w // 4 == c for w in wrong) for c in range(8)) <= 1


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 200), (200, 250)]
    found = {r.id: r.component for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}, 250: 200, 300: 200}


def chunked(text):
    parts = text.split("\n")
    values = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in parts]
    starts = [0]
    for i in range(1, len(parts)):
        rolled = ((values[i - 2] if i >= 2 else 0) * lines.FACTOR + values[i - 1]) % lines.MODULUS
        if max(len(parts[i - 1]), len(parts[i])) >= lines.LONG_LINE or rolled % lines.MEAN_LINES == 0:
            starts.append(i)
    return parts, list(zip(starts, [*starts[1:], len(parts)]))


def expected_lines(texts):
    seen, out = set(), []
    for i, text in sorted(texts):
        if text is None:
            out.append((i, None, 0, 0))
            continue
        parts, chunks = chunked(text)
        left = []
        for a, b in chunks:
            chunk = "\n".join(parts[a:b])
            counts = (b - a > 1 or len(chunk) >= lines.LONG_LINE) and chunk.strip(" \t\n\x0b\x0c\r")
            if counts and chunk in seen:
                continue
            if counts:
                seen.add(chunk)
            left += parts[a:b]
        out.append((i, "\n".join(left), len(parts), len(parts) - len(left)))
    return out


def line_texts():
    passage = [prose(9, 900 + k) for k in range(12)]
    texts = []
    for k in range(25):
        own = [prose(8, 30 * k + j) for j in range(random.Random(k).randint(0, 6))]
        texts.append("\n".join([*own, *passage, *own[:2]]))
    texts += ["\n".join(prose(5, 7000 + k) for k in range(3000)), None, "", "\n\n\n", "\n\n\n", "one line", "one line", prose(60, 5), "head\n" + prose(60, 5) + "\ntail"]
    return list(enumerate(texts))


def test_lines_equal_plain_reading(spark):
    texts = line_texts()
    docs = frame(spark, random.Random(1).sample(texts, len(texts))).withColumnRenamed("lang", "n_lines")
    found = lines.dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_removed_lines"]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in found.collect() if r.doc_id is not None)
    assert got == expected_lines(texts)
    gone = sum(n for *_, n in got)
    assert gone > 24 * 6  # most of the shared passage goes wherever it begins
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_with_repeated_and_missing_identifiers(spark):
    body = "\n".join(prose(9, k) for k in range(10))
    docs = frame(spark, [(7, body), (7, body), (None, body), (None, "x"), (8, body)])
    found = sorted((r.doc_id or 0, r.n_removed_lines > 0) for r in lines.dedup_lines(docs).collect())
    assert found == [(0, False), (0, True), (7, False), (7, False), (8, True)]


def run_lines(text, least=lines.RUN_WORDS):
    """Every run of lines of over ``least`` words, as first line, end and text."""
    parts = text.split("\n")
    for a in range(len(parts)):
        for b in range(a + 1, len(parts) + 1):
            if sum(len(x.split()) for x in parts[a:b]) > least:
                yield a, b, "\n".join(parts[a:b])


def test_repeated_runs_go_whole(spark):
    """Runs of over 50 words in short lines, wherever they begin, against all runs; chunks alone leave lines of them."""
    texts = line_texts()[:25]
    texts += [(30 + k, "\n".join([f"one {k}", prose(53, 77), f"two {k}"])) for k in range(3)]
    texts += [(40 + k, "\n".join([f"own {k}", prose(20, 78), "", prose(20, 79), prose(13, 80), "", f"end {k}"])) for k in range(3)]
    texts += [(50, "\n".join([prose(10, 81)] * 30)), (51, "\n".join([prose(10, 81)] * 30))]
    seen, expected = {}, {}
    for i, text in texts:
        gone = set()
        for a, b, run in run_lines(text):
            first = seen.setdefault(run, (i, a))
            if first[0] != i or a >= first[1] + b - a:
                gone |= set(range(a, b))
        expected[i] = gone
    runs = lines.repeated_runs(frame(spark, texts)).collect()
    assert {i: {k for r in runs if r.id == i for k in range(r.start, r.start + r.lines)} for i, _ in texts} == expected
    left = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, texts), run_words=lines.RUN_WORDS).collect()}
    for i, text in texts[:-2]:
        assert left[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in expected[i])
    assert left[51] == ""
