"""Exact dedup against grouping by text; the mix against water-filling by hand."""

import hashlib

import pytest
from helpers import DOC, frame, rows_of

from meterflow.llm import exact, mixing


def expected_groups(texts, best):
    norm = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in texts:
        named = [x for x in groups[norm(t)] if x is not None]
        keep = best(named) if named else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "É"), (6, "é"), (6, "é"), (None, "SAME text"), (None, "alone"), (9, "x" * 300_000)]


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_exact_duplicates_equal_grouping(spark, keep, best):
    assert rows_of(exact.exact_duplicates(frame(spark, CASES), keep=keep)) == expected_groups(CASES, best)


def test_every_fan_in_merges_all_runs(spark):
    docs = frame(spark, [(i, f"text {i % 7}") for i in range(200)]).repartition(13)
    rows = exact.digests(docs)
    for fan_in, runs in ((2, 16), (3, 9), (8, 64)):
        merged = exact.merge_runs(rows, "smallest", fan_in, runs).collect()
        assert sorted((r.keep_id, r.group_size) for r in merged) == [(i, 29 if i < 4 else 28) for i in range(7)]


def test_every_round_sorts_its_runs(spark):
    rows = exact.digests(frame(spark, [(i, f"text {i % 7}") for i in range(50)]))
    plan = exact.merge_runs(rows, "smallest", 3, 27)._jdf.queryExecution().executedPlan().toString()
    first = plan.split("== Initial Plan ==")[-1]
    assert first.count("Sort [run#") >= 3 and first.count("Exchange hashpartitioning(run#") == 3 and "HashAggregate" not in first


def test_exact_on_an_empty_table_and_clashing_columns(spark):
    assert exact.exact_duplicates(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(1, "a", 5, "x"), (2, "A", 6, "y")], "doc_id long, text string, keep_id int, run string")
    assert [r[:4] for r in rows_of(exact.exact_duplicates(docs))] == [(1, 1, 2, True), (2, 1, 2, False)]


def water_filling(sizes, weights=mixing.WEIGHTS, budget=mixing.BUDGET, passes=mixing.MAX_PASSES):
    """Share by weight, stop at the cap, share the excess again, until no source is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), budget * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= passes * sizes[s] - 1e-9:
                left += target[s] - passes * sizes[s]
                target[s] = float(passes * sizes[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 90, "c": 80}, {"a": 5, "b": 500, "c": 40, None: 300}, {"x": 10}, {"a": 1, "b": 1, "c": 1000, "d": 3}])
def test_targets_are_those_of_water_filling(spark, sizes):
    totals = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(totals).collect()}
    assert found == pytest.approx(water_filling(sizes))


def test_mix_takes_the_targets(spark):
    rows = [(i, ("w " * (1 + i * 7 % 13)).strip(), "en", s, 0) for i, s in enumerate(["hot"] * 300 + ["b", "a", None, "hot"] * 20)]
    rows += [(900, None, "en", "a", 0), (901, "", "en", "b", 0), (902, "one two", "en", "b", 0), (902, "one two", "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOC)
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in mixed:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert target == pytest.approx(water_filling(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert rows_of(mixing.mix_sources(docs.repartition(5))) == sorted(map(tuple, mixed), key=str)


def test_virtual_time_orders_the_mix(spark):
    docs = spark.createDataFrame([(i, "w w w", "en", "ab"[i % 2], 0) for i in range(400)], DOC)
    queue = mixing.fair_queue(mixing.sized(docs))
    served = mixing.serve(queue).orderBy("offset").collect()
    assert [r.finish for r in served] == sorted(r.finish for r in served)
    ends = 0
    for r in served:
        assert r.offset == ends
        ends += r.taken
    half = [r for r in served if r.offset < ends // 3]
    words = {s: sum(r.taken for r in half if r.source == s) for s in "ab"}
    assert words["a"] / words["b"] == pytest.approx(5 / 2, rel=0.05)


def test_mixed_documents_with_columns_in_the_way(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1, 2, 3)], "doc_id long, text string, source string, id int, _id int, `check` int")
    assert mixing.mixed_documents(docs).columns == ["doc_id", "text", "source", "id", "_id", "check", "size", "taken", "offset"]
    assert mixing.mixed_documents(docs).count() == 1


def test_mixed_documents_keep_columns_and_share_evenly(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "x", 1, 7), (1, "a b c", "en", "x", 1, 7), (2, "d", "de", None, 1, 8)], DOC + ", taken int")
    out = mixing.mixed_documents(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "taken", "offset"]
    assert out.count() == 3 and out.where("doc_id = 1").select("taken").distinct().count() == 1
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    assert mixing.mix_sources(frame(spark, [None, ""])).select("target", "taken").distinct().collect() == [(0.0, 0)]
