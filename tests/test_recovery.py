"""The regression against numpy on the full design, and on simulated recovery."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import recovery
from tallygrid.operators.sensor_days import classify_sensors, sensor_days, with_sensor_type
from tallygrid.params import Params
from tallygrid.plans import analysis

PARAMS = Params(sensors=None)
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


# what each weekday keeps of its level; all seven differ
KEPT = {"Mon": 0.55, "Tue": 0.91, "Wed": 0.74, "Thu": 0.83, "Fri": 0.47, "Sat": 1.12, "Sun": 0.98}


def simulated(sensors=2, noise=0.05, keep=1.0, seed=11):
    """Unequal sensors that each miss a stretch of days, before and after the change."""
    rng = np.random.default_rng(seed)
    parts = []
    for period, first in (("2019", "2019-01-01"), ("recent", "2031-01-01")):
        days = pd.Series(pd.date_range(first, periods=365))
        for sensor in range(sensors):
            here = pd.DataFrame({"sensor_id": sensor, "date": days, "period": period})
            here["dow"] = days.dt.day_name().str[:3]
            here["month"] = days.dt.month
            here["week"] = days.dt.strftime("%G-%V")
            level = 90 * 3.7**sensor * (1 + 0.2 * np.cos(here["month"] + sensor))
            ratio = here["dow"].map(KEPT) if period == "recent" else 1.0
            here["daily"] = level * ratio * np.exp(rng.normal(0, noise, len(days)))
            gap = (days.dt.dayofyear >= 30 + 100 * sensor) & (days.dt.dayofyear < 45 + 100 * sensor)
            parts.append(here[~gap & (rng.random(len(days)) <= keep)])
    out = pd.concat(parts, ignore_index=True)
    return out.assign(date=out["date"].dt.date)


def full_design(d):
    """Dummy columns for everything, as a plain least-squares fit would build them."""
    cols = {"const": np.ones(len(d))}
    cols |= {f"s{s}": (d.sensor_id == s) * 1.0 for s in sorted(d.sensor_id.unique())[1:]}
    cols |= {f"m{m}": (d.month == m) * 1.0 for m in sorted(d.month.unique())[1:]}
    cols |= {f"d{x}": (d.dow == x) * 1.0 for x in DAYS if x != "Wed" and (d.dow == x).any()}
    recent = (d.period == "recent") * 1.0
    cols["recent"] = recent
    cols |= {f"r{x}": (d.dow == x) * recent for x in DAYS if x != "Wed" and (d.dow == x).any()}
    return pd.DataFrame(cols)


def expected(d, weights):
    x, y = full_design(d), np.log(d.daily.to_numpy())
    inverse = np.linalg.pinv(x.to_numpy().T @ x.to_numpy())
    beta = inverse @ x.to_numpy().T @ y
    u = y - x.to_numpy() @ beta
    scores = pd.DataFrame(x.to_numpy() * u[:, None]).groupby(d.week.to_numpy()).sum().to_numpy()
    n, k, g = len(d), x.shape[1], scores.shape[0]
    cov = inverse @ scores.T @ scores @ inverse * g / (g - 1) * (n - 1) / (n - k)
    w = pd.Series(0.0, index=x.columns)
    for day, weight in weights.items():
        w["recent"] += weight
        if day != "Wed":
            w[f"r{day}"] += weight
    return float(w @ beta), float(np.sqrt(w @ cov @ w))


def frame(spark, d):
    return spark.createDataFrame(
        d.astype({"date": object}),
        "sensor_id int, date date, period string, dow string, month int, week string, daily double",
    )


def observed(spark, d):
    return recovery.observations(frame(spark, d), {"all": ("daily", F.lit(True))})


@pytest.mark.parametrize("sensors, keep", [(1, 1.0), (4, 0.6)])
def test_estimates_and_errors_equal_the_full_regression(spark, sensors, keep):
    d = simulated(sensors, 0.3, keep)
    fitted = recovery.fit_recovery(observed(spark, d), PARAMS)
    weights = {**recovery.single_days(), "gap": recovery.gap_weights()}
    for row in recovery.contrasts(fitted, weights).collect():
        estimate, se = expected(d, weights[row.contrast])
        assert row.estimate == pytest.approx(estimate, abs=1e-9)
        assert row.se == pytest.approx(se, rel=1e-7)


def test_all_seven_ratios_come_back(spark):
    fitted = recovery.fit_recovery(observed(spark, simulated(3, 0.08)), PARAMS)
    rows = {r.day: r for r in recovery.by_weekday(fitted).collect()}
    for day, ratio in KEPT.items():
        assert rows[day].ratio == pytest.approx(ratio, rel=0.04)
        assert rows[day].low < rows[day].ratio < rows[day].high


def test_gap_of_the_outer_days(spark):
    gap = recovery.monfri_gap(recovery.fit_recovery(observed(spark, simulated(3, 0.08)), PARAMS)).first()
    outer = np.log([KEPT["Mon"], KEPT["Fri"]]).mean()
    inner = np.log([KEPT["Tue"], KEPT["Wed"], KEPT["Thu"]]).mean()
    assert gap.gap == pytest.approx(np.exp(outer - inner) - 1, abs=0.02)
    assert gap.low < gap.gap < gap.high < 0


def test_missing_months_are_handled(spark):
    d = simulated(2, 0.1)
    d = d[~((d.month >= 6) & (d.period == "recent")) & (d.month != 12)]
    got = recovery.contrasts(recovery.fit_recovery(observed(spark, d), PARAMS), {"gap": recovery.gap_weights()}).first()
    estimate, se = expected(d, recovery.gap_weights())
    assert got.estimate == pytest.approx(estimate, abs=1e-8) and got.se == pytest.approx(se, rel=1e-6)


def test_unseen_weekday_gives_null(spark):
    d = simulated(1)
    d = d[d.dow != "Sun"]
    rows = {r.day: r for r in recovery.by_weekday(recovery.fit_recovery(observed(spark, d), PARAMS)).collect()}
    assert rows["Sun"].ratio is None and rows["Mon"].ratio is not None


def test_many_fits_equal_single_fits(spark):
    d = simulated(3, 0.2)
    everyone = recovery.monfri_gap(
        recovery.fit_recovery(recovery.per_sensor_observations(frame(spark, d), "daily"), PARAMS)
    ).collect()
    assert len(everyone) == 3
    for row in everyone:
        estimate, _ = expected(d[d.sensor_id == int(row.fit)].reset_index(drop=True), recovery.gap_weights())
        assert row.gap == pytest.approx(np.exp(estimate) - 1, abs=1e-9)


def test_zero_totals_drop_out(spark):
    d = simulated(1)
    d.loc[0, "daily"] = 0.0
    assert observed(spark, d).count() == len(d) - 1


def test_sensor_days_windows_and_rules(spark, make_counts):
    whole, holiday, short, outside = date(2019, 3, 4), date(2019, 3, 5), date(2019, 3, 6), date(2020, 3, 4)
    dead = date(2019, 3, 7)
    counts = make_counts(
        [(1, d, h, 0 if d == dead else h) for d in (whole, holiday, outside, dead) for h in range(24)]
        + [(1, short, h, h) for h in range(23)]
    )
    calendar = spark.createDataFrame(
        [(d, d == holiday) for d in (whole, holiday, short, outside, dead)], "date date, is_holiday boolean"
    )
    rows = sensor_days(counts, calendar, PARAMS).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.daily, r.am_peak, r.lunch, r.pm_peak, r.evening) == (276, 24, 25, 51, 105)
    assert (r.period, r.dow, r.month, r.week) == ("2019", "Mon", 3, "2019-10")


def test_sensor_classes(spark):
    rows = [(s, "2019", d, v) for s, d, v in ((1, "Mon", 130.0), (1, "Sat", 100.0), (2, "Mon", 129.0), (2, "Sun", 100.0), (3, "Mon", 5.0))]
    days = spark.createDataFrame(rows, "sensor_id int, period string, dow string, daily double")
    types = classify_sensors(days, PARAMS)
    assert {r.sensor_id: r.type for r in types.collect()} == {1: "office", 2: "retail/leisure", 3: "retail/leisure"}
    unknown = spark.createDataFrame([(9, "recent", "Mon", 1.0)], days.schema)
    assert with_sensor_type(unknown, types).first().type == "retail/leisure"


def test_reports_from_one_table_of_days(spark):
    d = simulated(4, 0.1)
    days = frame(spark, d)
    for window in ("am_peak", "lunch", "pm_peak", "evening"):
        days = days.withColumn(window, F.col("daily") / 4)
    days = days.withColumn("type", F.when(F.col("sensor_id") < 2, "office").otherwise("retail/leisure")).withColumn(
        "upgraded", F.col("sensor_id") == 0
    )
    assert analysis.weekday_recovery_by_type(days, PARAMS).count() == 14
    assert analysis.recovery_by_window(days, PARAMS).count() == 2 * 4 * 3
    assert analysis.gap_by_window(days, PARAMS).count() == 6
    checks = {r.sample: r for r in analysis.robustness(days, PARAMS).collect()}
    assert checks["All office sensors"].sensors == 2 and checks["Only upgraded sensors"].sensors == 1
    assert checks["All office sensors"].mon_fri_vs_base == pytest.approx((KEPT["Mon"] * KEPT["Fri"]) ** 0.5, abs=0.03)
    shares = analysis.gap_share(analysis.per_sensor_gap(days, PARAMS)).first()
    assert tuple(shares) == (4, 4)


def test_sums_travel_packed(spark):
    """One array per batch and fit; no row for a pair of columns anywhere in the plan."""
    d = frame(spark, simulated(3, 0.08))
    fitted = recovery.fit_recovery(recovery.per_sensor_observations(d, "daily"), PARAMS)
    plan = recovery.monfri_gap(fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "inline" not in plan and "mapinarrow" in plan.lower()


def test_packed_sums_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    fits = rng.choice(["a", "b", "c"], 500)
    v, value, w = rng.normal(size=(500, recovery.WIDTH)), rng.normal(size=500), rng.random(500)
    rows = [(str(f), x.tolist(), float(y), float(n)) for f, x, y, n in zip(fits, v, value, w)] + [(None, [1.0] * recovery.WIDTH, 2.0, 3.0)]
    found = recovery.packed_sums(spark.createDataFrame(rows, "fit string, v array<double>, value double, w double"))
    found = {r.fit: recovery._matrix(r.sums) for r in found.collect()}
    assert set(found) == {"a", "b", "c", None}
    for fit in "abc":
        own = fits == fit
        left = v[own].T * w[own]
        assert np.allclose(found[fit][0], left @ v[own]) and np.allclose(found[fit][1], left @ value[own])
    assert np.allclose(found[None][1], 6.0)
