"""Partial results of loads against a rebuild from all counts."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import coverage, features, incremental
from tallygrid.operators.sensor_days import day_totals
from tallygrid.params import Params
from tallygrid.sources import day_parts, store

ALL = Params(sensors=None)
FIRST = date(2031, 5, 20)


def batch(make_counts, start, days, sensors, level, dead=()):
    """Daytime counts of some sensors; ``dead`` (sensor, day number) pairs are zero all day."""
    rows = [
        (s, start + timedelta(n), h, 0 if (s, n) in dead else level + s % 7 + h)
        for s in sensors for n in range(days) for h in range(6, 22)
    ]
    return make_counts(rows).drop("source")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def same_as_rebuilt(spark, root):
    counts = store.read_counts(spark, root)
    days = day_parts.read_days(spark, root, ALL)
    rebuilt = day_totals(counts, ALL)
    assert rows(days.select(rebuilt.columns)) == rows(rebuilt)
    assert rows(day_parts.read_faults(spark, root, ALL)) == rows(coverage.fault_days(counts, ALL))
    summary = incremental.dataset_summary(counts)
    assert rows(day_parts.summary(spark, root, ALL).select(summary.columns)) == rows(summary)
    monthly = coverage.monthly_completeness(counts, ALL).select("sensor_id", "month", "hours")
    assert rows(day_parts.read_monthly(spark, root, ALL).select(monthly.columns)) == rows(monthly)


def test_parts_follow_loads_that_replace_part_of_a_month(spark, tmp_path, make_counts):
    root = str(tmp_path / "lake")
    # ids on both sides of a block's end, and one below zero
    archive = batch(make_counts, FIRST, 60, [-3, 1, 32768, 32769, 70_001], 10, {(1, 3), (1, 50)})
    store.append_counts(spark, root, archive, "historic")
    assert day_parts.maintain(spark, root, ALL) == 1
    same_as_rebuilt(spark, root)

    # live data hides the archive from the middle of June on, also its fault of day 50
    live = batch(make_counts, FIRST + timedelta(27), 30, [1, 2, 32769], 90, {(2, 4), (2, 20)})
    store.append_counts(spark, root, live, "live")
    with pytest.raises(LookupError, match="live"):
        day_parts.summary(spark, root, ALL)
    assert day_parts.maintain(spark, root, ALL) == 1
    same_as_rebuilt(spark, root)

    # a second live load replaces one month in part: sensor 2 is gone from there on
    again = batch(make_counts, FIRST + timedelta(40), 25, [1, 5], 300)
    store.append_counts(spark, root, again, "live")
    assert day_parts.maintain(spark, root, ALL) == 1
    same_as_rebuilt(spark, root)
    assert rows(day_parts.read_faults(spark, root, ALL)) == [
        (1, FIRST + timedelta(3)), (2, FIRST + timedelta(31))
    ]
    assert day_parts.maintain(spark, root, ALL) == 0


def test_another_definition_of_a_day_has_parts_of_its_own(spark, tmp_path, make_counts):
    root = str(tmp_path / "lake")
    store.append_counts(spark, root, batch(make_counts, FIRST, 5, [4], 0, {(4, 2)}), "live")
    strict = ALL.with_(fault_min_rows=14)
    assert day_parts.name_of(strict) != day_parts.name_of(ALL)
    day_parts.maintain(spark, root, ALL)
    with pytest.raises(LookupError):
        day_parts.read_faults(spark, root, strict)
    day_parts.maintain(spark, root, strict)
    assert day_parts.read_faults(spark, root, ALL).count() == 1
    assert day_parts.read_faults(spark, root, strict).count() == 0


def test_an_empty_store_has_empty_parts(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert day_parts.maintain(spark, root, ALL) == 0
    assert day_parts.summary(spark, root, ALL).count() == 0
    assert day_parts.read_days(spark, root, ALL).count() == 0
    assert day_parts.read_faults(spark, root, ALL).count() == 0


def test_stored_parts_are_read_without_a_shuffle(spark, tmp_path, make_counts):
    root = str(tmp_path / "lake")
    store.append_counts(spark, root, batch(make_counts, FIRST, 40, [1, 2], 5, {(1, 1)}), "live")
    day_parts.maintain(spark, root, ALL)
    faults = day_parts.read_faults(spark, root, ALL)
    kept = features.without_faults(store.read_counts(spark, root), ALL, faults)
    assert kept.count() == (2 * 40 - 1) * 16
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    # the log's window is the only grouping; counts and faults meet in a broadcast
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    days = day_parts.read_days(spark, root, ALL).where(F.col("month") == F.lit(date(2031, 6, 1)))
    assert "Aggregate" not in days._jdf.queryExecution().sparkPlan().toString().split("Window")[0]
