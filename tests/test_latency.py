"""Delay between the freshest reading of a slice and its first write."""

from meterflow.operators import measure as m

STORED = "event_ts long, first_written_at long"


def test_a_report_of_no_valid_rows_counts_none(spark):
    # dense readings: every slice is written in mid-slice and updated after that, so no delay is plausible
    late = spark.createDataFrame([(2_000, 1_000), (0, 1_000)], STORED)
    for rows in (late, late.limit(0)):
        assert [tuple(r) for r in m.latency_report(rows).collect()] == [(0, None, None, None, None, None, None)]
    assert m.latency_report(late).schema["samples"].dataType.typeName() == "long"


def test_a_report_of_two_rows(spark):
    rows = spark.createDataFrame([(1_000, 2_000), (1_000, 1_000), (2_000, 1_000)], STORED)
    assert [tuple(r) for r in m.latency_report(rows).collect()] == [(2, 500.0, 500.0, 950.0, 990.0, 1_000, 0)]
