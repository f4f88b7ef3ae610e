"""Rounds of connected components: small plans, the same components."""

import random

from meterflow.llm import neardup


def test_a_round_is_planned_without_repeated_steps(spark, monkeypatch):
    plans, written = [], neardup.written

    def recorded(frame, name):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return written(frame, name)

    monkeypatch.setattr(neardup, "written", recorded)
    pick, n = random.Random(3), 400
    pairs = [(pick.randrange(n), pick.randrange(n)) for _ in range(260)]
    found = {r.id: r.component for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    lowest = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    assert found == {i: c for i, c in enumerate(lowest) if c != i}
    assert len(plans) > 4
    assert max(p.count("Aggregate [") for p in plans) <= 2 and max(p.count("Relation [") for p in plans) <= 2
