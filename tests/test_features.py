"""Lag features, season, feature table: exact values and leakage."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import calendar as cal
from tallygrid.operators import features, season
from tallygrid.operators.weather import VIEW_COLUMNS
from tallygrid.params import Params

ONE = Params(sensors=(4,))
SITE = Params(sensors=(71,))


@pytest.fixture
def plain_calendar(spark):
    def make(start, end, holidays=()):
        from tallygrid.sources import reference_files, schemas

        rows = spark.createDataFrame([(d, "Day off") for d in holidays], schemas.HOLIDAYS)
        return cal.build_calendar(
            cal.day_spine(spark, start, end),
            rows,
            reference_files.known_terms(spark),
            reference_files.known_events(spark),
            ONE.event_names,
        )

    return make


def no_weather(spark):
    names = ["date date", "hour tinyint", *[f"{c} double" for c in VIEW_COLUMNS]]
    return spark.createDataFrame([], ", ".join(names))


def flat_season(spark):
    return spark.range(1, 367).select(F.col("id").cast("int").alias("doy"), F.lit(1.0).alias("season"))


def test_baseline_ignores_counts_not_yet_published(make_counts):
    day = date(2026, 3, 3)
    ages = {0: 1000, 7: 9999, 28: 8888, 35: 300, 49: 500}
    counts = make_counts([(4, day - timedelta(a), 9, c) for a, c in ages.items()])
    row = features.seasonal_baseline(counts, day, day, ONE).first()
    assert (row["count"], row.baseline, row.baseline_weeks) == (1000, 400.0, 2)


def test_baseline_is_null_without_history(make_counts):
    row = features.seasonal_baseline(make_counts([(4, date(2026, 3, 3), 9, 5)]), date(2026, 3, 1), date(2026, 3, 9), ONE).first()
    assert row.baseline is None and row.baseline_weeks == 0


def test_too_fresh_lags_are_refused():
    with pytest.raises(ValueError, match="28"):
        Params(baseline_lags=(28, 35))


def test_lags_reach_back_whole_weeks_and_no_fresher(spark, leveled, level, plain_calendar):
    counts, start = leveled(90)
    day = start + timedelta(70)
    rows = features.build_dataset(
        counts, plain_calendar(start, start + timedelta(90)), no_weather(spark), flat_season(spark), day, day, SITE
    )
    got = {r.hour: r for r in rows.collect()}
    past = {lag: level(day - timedelta(lag)) for lag in (0, 35, 42, 49, 56)}
    assert sorted(got) == [6, 18] and got[6]["count"] == past[0]
    assert (got[6].lag_35, got[6].lag_42, got[6].lag_364) == (past[35], past[42], None)
    assert got[18].lag_42 == past[42] // 2
    assert got[6].baseline == pytest.approx(sum(past[lag] for lag in (35, 42, 49, 56)) / 4)
    assert got[6].dow == day.isoweekday() % 7 and got[6].doy == day.timetuple().tm_yday
    assert got[6].school_term is None and got[6].temperature is None


def test_baseline_matches_a_brute_force_over_gaps(spark, make_counts):
    rng = np.random.default_rng(3)
    rows = [
        (int(s), date(2025, 1, 1) + timedelta(int(d)), int(h), int(c))
        for s in (1, 2) for d in range(90) for h in (3, 9)
        for c in [rng.integers(0, 50)] if rng.random() < 0.7
    ]
    known = {(s, d, h): c for s, d, h, c in rows}
    got = features.seasonal_baseline(make_counts(rows), date(2025, 2, 20), date(2025, 3, 31), Params(sensors=None)).collect()
    assert len(got) == sum(date(2025, 2, 20) <= d <= date(2025, 3, 31) for _, d, _ in known)
    for r in got:
        past = [known[k] for lag in (35, 42, 49, 56) if (k := (r.sensor_id, r.date - timedelta(lag), r.hour)) in known]
        assert r.baseline_weeks == len(past)
        assert r.baseline == (pytest.approx(sum(past) / len(past)) if past else None)


def test_fault_days_are_neither_target_nor_history(spark, make_counts, plain_calendar):
    start = date(2025, 1, 1)
    dead = {start, start + timedelta(35)}
    rows = [
        (4, start + timedelta(d), h, 0 if start + timedelta(d) in dead else 10)
        for d in (0, 7, 35, 42) for h in range(8, 21)
    ]
    data = features.build_dataset(
        make_counts(rows), plain_calendar(start, start + timedelta(60)), no_weather(spark), flat_season(spark),
        start, start + timedelta(60), ONE,
    )
    assert {r.date for r in data.select("date").distinct().collect()} == {start + timedelta(7), start + timedelta(42)}
    last = data.where(F.col("date") == F.lit(start + timedelta(42))).first()
    assert last.lag_42 is None and last.lag_35 == 10.0  # 42 days before was dead


def test_coming_hours_are_those_of_the_day(spark, leveled, level, plain_calendar):
    counts, start = leveled(60)
    first, last = start + timedelta(63), start + timedelta(64)
    params = SITE.with_(slots_per_day=2, hours=(6, 18))
    names = ["date date", "hour tinyint", *[f"{c} double" for c in VIEW_COLUMNS]]
    supplied = spark.createDataFrame([(first, 18, *[3.5] * 7)], ", ".join(names))
    rows = features.build_dataset(
        counts, plain_calendar(start, last, holidays=[last]), supplied, flat_season(spark), first, last, params,
        future=spark.createDataFrame([(71,)], "sensor_id int"),
    )
    got = {(r.date, r.hour): r for r in rows.collect()}
    assert sorted(got) == [(d, h) for d in (first, last) for h in (6, 18)]
    assert all(r["count"] is None and r.baseline is not None for r in got.values())
    assert got[first, 6].lag_35 == level(first - timedelta(35))
    assert got[first, 18].temperature == 3.5 and got[first, 6].temperature is None
    assert (got[first, 6].is_holiday, got[last, 6].is_holiday) == (0.0, 1.0)


def test_hours_and_slots_must_agree():
    with pytest.raises(ValueError, match="slots"):
        Params(slots_per_day=4, hours=(0, 12))


def pandas_season(days: pd.DataFrame) -> pd.Series:
    """Plain restatement of the season: relative level, interpolation, circular mean."""
    yearly = days.groupby(["sensor_id", days.date.dt.year]).total.transform("mean")
    level = (days.total / yearly).groupby(days.date.dt.dayofyear).mean()
    full = level.reindex(range(1, 367)).interpolate().to_numpy()
    around = [[full[(d + k) % 366] for k in range(-3, 4)] for d in range(366)]
    return pd.Series([np.mean(a) if not np.isnan(a).any() else np.nan for a in around], index=range(1, 367))


@pytest.mark.parametrize("gaps", [[], [20, 21, 22, 200], [360, 361, 362, 363, 364, 365, 366], [1, 2]])
def test_season_matches_pandas(spark, make_counts, gaps):
    rng = np.random.default_rng(1)
    axis = pd.date_range("2015-01-01", "2016-12-31")
    days = pd.DataFrame(
        [(s, d, int(rng.integers(50, 150))) for s in (1, 2) for d in axis if d.dayofyear not in gaps],
        columns=["sensor_id", "date", "total"],
    )
    rows = [(r.sensor_id, r.date.date(), h, v) for r in days.itertuples() for h, v in ((8, r.total - 5), (9, 5))]
    params = Params(sensors=None, slots_per_day=2)
    got = season.season_index(make_counts(rows), params).toPandas().set_index("doy").season.sort_index()
    want = pandas_season(days)
    assert len(got) == 366
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), rtol=1e-9)
    table = season.season_table(spark.createDataFrame(got.reset_index().astype(object).where(lambda x: x.notna(), None), "doy int, season double"), params)
    row = table.where("doy = 366").first()
    past = np.mean([want[(366 - lag - 1) % 365 + 1] for lag in (35, 42, 49, 56)])
    if np.isnan(want[366]) or np.isnan(past):
        assert row.season_change is None
    else:
        assert row.season_change == pytest.approx(want[366] / past)


def test_hot_sensor_spreads_over_hours_and_weekdays(make_counts):
    counts = make_counts([(1, date(2025, 1, 1), 1, 1)])
    plan = features.seasonal_baseline(counts, date(2025, 1, 1), date(2025, 1, 2), Params(sensors=None))
    text = plan._jdf.queryExecution().toString()
    assert "hashpartitioning(sensor_id" in text and "hour" in text and "_w0" in text
    assert text.count("Exchange hashpartitioning") == text.count("Exchange")
