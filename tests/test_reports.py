"""Coverage, series, profiles and scores on small fixtures."""

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrid.functions import dates, numbers
from tallygrid import fixed
from tallygrid.operators import coverage, profiles, scoring, series
from tallygrid.params import Params

ALL = Params(sensors=None)


@pytest.mark.parametrize(
    "value, label",
    [(0.0, "Dry"), (0.01, "0–1 mm"), (1.0, "0–1 mm"), (3.0, "1–3 mm"), (3.01, "3+ mm"), (100.0, "3+ mm"),
     (100.5, None), (-1.0, None), (None, None)],
)
def test_rain_classes_close_on_the_right(spark, value, label):
    row = spark.createDataFrame([(value,)], "v double").select(
        numbers.right_closed("v", fixed.RAIN_EDGES, fixed.RAIN_LABELS).alias("c")
    )
    assert row.first().c == label


@pytest.mark.parametrize("value, label", [(10.0, "<10°"), (10.1, "10–15°"), (35.0, "30–35°"), (35.1, "35°+"), (-5.0, None)])
def test_temperature_classes(spark, value, label):
    row = spark.createDataFrame([(value,)], "v double").select(
        numbers.right_closed("v", fixed.TEMPERATURE_EDGES, fixed.TEMPERATURE_LABELS).alias("c")
    )
    assert row.first().c == label


def test_date_expressions(spark):
    days = spark.createDataFrame([(date(2021, 1, 3),), (date(2021, 1, 4),), (date(2020, 2, 10),)], "d date")
    got = {
        r.d: (r.w, r.n, r.i, r.e, r.t, r.m)
        for r in days.select(
            "d", dates.weekday("d").alias("w"), dates.weekday_name("d").alias("n"), dates.iso_week("d").alias("i"),
            dates.week_end("d").alias("e"), dates.day_type("d").alias("t"), dates.days_in_month("d").alias("m"),
        ).collect()
    }
    assert got[date(2021, 1, 3)] == (0, "Sun", "2020-53", date(2021, 1, 3), "Weekend", 31)
    assert got[date(2021, 1, 4)] == (1, "Mon", "2021-01", date(2021, 1, 10), "Monday", 31)
    assert got[date(2020, 2, 10)][5] == 29


@pytest.mark.parametrize("rows, is_fault", [(9, False), (10, True)])
def test_fault_needs_ten_silent_daytime_hours(make_counts, rows, is_fault):
    day = date(2025, 5, 5)
    counts = make_counts([(1, day, 8 + h, 0) for h in range(rows)] + [(1, day, 3, 50)])
    assert coverage.fault_days(counts, ALL).count() == int(is_fault)


def test_coverage_uses_full_period_lengths(spark, make_counts):
    counts = make_counts([(1, date(2019, 1, 1), h, 10) for h in range(24)] + [(1, date(2025, 1, 1), h, 5) for h in range(12)])
    sensors = spark.createDataFrame(
        [(1, "A", -37.815, 144.96, None), (2, "B", 0.0, 0.0, "x")],
        "location_id int, sensor_description string, latitude double, longitude double, note string",
    )
    rows = coverage.sensor_coverage(counts, sensors, ALL).collect()
    assert len(rows) == 1
    assert rows[0].cov_base == 24 / 8760 and rows[0].cov_recent == 12 / 17520
    assert rows[0].recent_vs_base == 0.5
    easy = ALL.with_(min_coverage=0.0)
    assert coverage.select_sensors(coverage.sensor_coverage(counts, sensors, easy), easy).first().selected


def test_completeness_grid_keeps_empty_months(make_counts):
    counts = make_counts([(1, date(2024, 3, d), 5, 1) for d in range(1, 4)] + [(2, date(2024, 1, 1), 5, 1)])
    monthly = coverage.monthly_completeness(counts, ALL)
    grid = coverage.completeness_grid(monthly, date(2024, 1, 1), date(2024, 4, 1)).collect()
    assert [r.sensor_id for r in grid] == [2, 1]
    assert grid[1]["2024-03"] == 3 / (31 * 24) and grid[1]["2024-02"] is None and grid[1]["2024-04"] is None


def test_smoothing_needs_twenty_days_and_keeps_gaps(spark):
    start = date(2024, 1, 1)
    present = [d for d in range(80) if not 30 <= d < 45]
    rows = spark.createDataFrame([(start + timedelta(d), float(d)) for d in present], "date date, index double")
    got = {r.date: r.smooth for r in series.smoothed_series(rows, ALL).collect()}
    want = pd.Series({pd.Timestamp(start + timedelta(d)): float(d) for d in present}).asfreq("D").rolling(28, min_periods=20).mean()
    assert len(got) == len(want) == 80
    for day, value in want.items():
        mine = got[day.date()]
        assert mine is None if pd.isna(value) else mine == pytest.approx(value)


def test_weekly_history_keeps_empty_weeks(make_counts):
    two = ALL.with_(slots_per_day=2)
    days = [date(2024, 1, 1), date(2024, 1, 3), date(2024, 1, 18)]
    counts = make_counts([(1, d, h, 10 * d.day) for d in days for h in (1, 2)] + [(1, date(2024, 1, 4), 1, 999)])
    got = {r.week: r.people for r in series.weekly_history(counts, two).collect()}
    assert got == {date(2024, 1, 7): 40.0, date(2024, 1, 14): None, date(2024, 1, 21): 360.0}


def test_index_uses_each_sensors_own_base(make_counts):
    one = ALL.with_(slots_per_day=1)
    counts = make_counts([(1, date(2019, 1, 1), 5, 100), (1, date(2025, 1, 1), 5, 50), (2, date(2019, 1, 2), 5, 10), (2, date(2025, 1, 1), 5, 10), (3, date(2025, 1, 1), 5, 7)])
    got = {r.date: (r["index"], r.sensors) for r in series.indexed_series(counts, one).collect()}
    assert got[date(2025, 1, 1)] == (75.0, 2)  # sensor 3 has no base


def test_relative_to_median_skips_zero_medians(spark, make_counts):
    counts = make_counts([(1, date(2019, 1, d), 9, c) for d, c in ((7, 10), (14, 20), (21, 40))] + [(2, date(2019, 1, 7), 9, 0)])
    hourly = counts.select("sensor_id", "date", "hour", "count").withColumns(
        {"temperature": F.lit(20.0), "precipitation_mm": F.lit(0.0)}
    )
    rows = profiles.relative_to_median(hourly, ALL)
    assert sorted(r.relative for r in rows.collect()) == [0.5, 1.0, 2.0]
    rain = profiles.rain_effect(rows).first()
    assert (rain.bucket, rain.hours) == ("Dry", 3)


def test_score(spark):
    rows = spark.createDataFrame(
        [(100, 110.0, "a"), (300, 270.0, "b"), (50, None, "b"), (None, 5.0, "a"), (10, float("nan"), "a")],
        "count int, pred double, kind string",
    )
    overall = scoring.score(rows, "pred").first()
    assert (overall.mae, overall.wape, overall.hours) == (20.0, pytest.approx(0.1), 2)
    by = {r.kind: r.wape for r in scoring.score(rows, "pred", "kind").collect()}
    assert by == {"a": pytest.approx(0.1), "b": pytest.approx(0.1)}
    zero = spark.createDataFrame([(0, 5.0)], "count int, pred double")
    assert scoring.score(zero, "pred").first().wape is None


def test_signed_percent(spark):
    from tallygrid.functions.text import signed_percent

    row = spark.createDataFrame([(0.123, -0.04, None)], "a double, b double, c double").select(
        signed_percent(F.col("a")).alias("a"), signed_percent(F.col("b")).alias("b"), signed_percent(F.col("c")).alias("c")
    ).first()
    assert tuple(row) == ("+12%", "-4%", None)
