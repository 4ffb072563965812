"""The then-vs-now study: every table of the report from one set of sensor-days."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.text import mentions
from ..operators import recovery
from ..operators.sensor_days import classify_sensors, sensor_days, with_sensor_type
from ..params import Params
from ..session import written

GROUPS = {"Office district": fixed.OFFICE_CLASS, "Retail / leisure": fixed.RETAIL_CLASS}
DAYTIME_WINDOWS = ("am_peak", "lunch", "pm_peak", "evening")
GAP_WINDOWS = ("daily", "am_peak", "evening")


def study_days(
    counts: DataFrame, calendar: DataFrame, sensors: DataFrame, params: Params
) -> DataFrame:
    """Sensor-days with sensor class and upgrade flag, written once.

    All reports read this table, so the counts themselves are scanned once.
    """
    days = written(sensor_days(counts, calendar, params), "sensor-days")
    typed = with_sensor_type(days, classify_sensors(days, params))
    upgraded = sensors.select(
        F.col("location_id").alias("sensor_id"),
        mentions("note", params.upgrade_word).alias("upgraded"),
    )
    return typed.join(upgraded, "sensor_id", "left").withColumn(
        "upgraded", F.coalesce("upgraded", F.lit(False))
    )


def fit_many(days: DataFrame, fits: Mapping[str, tuple[str, Column]], params: Params) -> DataFrame:
    return recovery.fit_recovery(recovery.observations(days, fits), params)


def weekday_recovery(days: DataFrame, params: Params) -> DataFrame:
    """Recovery by weekday over all sensors."""
    fitted = fit_many(days, {"All sensors": ("daily", F.lit(True))}, params)
    return recovery.by_weekday(fitted).drop("fit")


def weekday_recovery_by_type(days: DataFrame, params: Params) -> DataFrame:
    """Recovery by weekday for office and for retail sensors."""
    fits = {name: ("daily", F.col("type") == kind) for name, kind in GROUPS.items()}
    return recovery.by_weekday(fit_many(days, fits, params)).withColumnRenamed("fit", "group")


def recovery_by_window(days: DataFrame, params: Params) -> DataFrame:
    """Recovery by group of sensors, time window and group of days."""
    fitted = fit_many(days, _group_windows(DAYTIME_WINDOWS), params)
    return _named(recovery.by_day_group(fitted))


def gap_by_window(days: DataFrame, params: Params) -> DataFrame:
    """Mon + Fri gap by group of sensors and time window."""
    return _named(recovery.monfri_gap(fit_many(days, _group_windows(GAP_WINDOWS), params)))


def robustness(days: DataFrame, params: Params) -> DataFrame:
    """Office sensors in five samples: ratios by day group and the morning gap."""
    office = F.col("type") == fixed.OFFICE_CLASS
    base = F.col("period") == params.base_label
    second_year = _year_after(params.recent_start)
    samples = {
        "All office sensors": office,
        "Only upgraded sensors": office & F.col("upgraded"),
        "Only sensors not upgraded": office & ~F.col("upgraded"),
        "First recent year": office & (base | (F.col("date") < F.lit(second_year))),
        "Second recent year": office & (base | (F.col("date") >= F.lit(second_year))),
    }
    fits = {
        f"{name}|{window}": (window, rule)
        for name, rule in samples.items()
        for window in ("daily", "am_peak")
    }
    weights = {**fixed.DAY_GROUPS, "gap": recovery.gap_weights()}
    rows = recovery.contrasts(fit_many(days, fits, params), weights)
    name, window = F.split_part("fit", F.lit("|"), F.lit(1)), F.split_part("fit", F.lit("|"), F.lit(2))
    daily, morning = window == "daily", window == "am_peak"
    level = F.exp("estimate")
    return rows.groupBy(name.alias("sample")).agg(
        *[
            F.max(F.when(daily & (F.col("contrast") == group), level)).alias(column)
            for group, column in zip(
                fixed.DAY_GROUPS, ("mon_fri_vs_base", "tue_thu_vs_base", "weekend_vs_base")
            )
        ],
        F.max(F.when(morning & (F.col("contrast") == "gap"), level - 1)).alias("morning_gap"),
        F.max(F.when(daily, F.col("sensors"))).alias("sensors"),
    )


def per_sensor_gap(days: DataFrame, params: Params, window: str = "am_peak") -> DataFrame:
    """Mon + Fri gap of each sensor on its own, with its class."""
    fitted = recovery.fit_recovery(recovery.per_sensor_observations(days, window), params)
    types = days.select("sensor_id", "type").distinct()
    return (
        recovery.monfri_gap(fitted)
        .select(F.col("fit").cast("int").alias("sensor_id"), "gap", "low", "high", "p")
        .join(types, "sensor_id")
    )


def gap_share(gaps: DataFrame) -> DataFrame:
    """One row: sensors with a negative gap and sensors in all."""
    return gaps.agg(
        F.count_if(F.col("gap") < 0).alias("with_gap"), F.count("*").alias("sensors")
    )


def _group_windows(windows) -> dict[str, tuple[str, Column]]:
    return {
        f"{name}|{window}": (window, F.col("type") == kind)
        for name, kind in GROUPS.items()
        for window in windows
    }


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.split_part("fit", F.lit("|"), F.lit(1)).alias("group"),
        F.split_part("fit", F.lit("|"), F.lit(2)).alias("window"),
        *[c for c in rows.columns if c != "fit"],
    )


def _year_after(day: date) -> date:
    try:
        return day.replace(year=day.year + 1)
    except ValueError:  # 29 February
        return day + timedelta(366)
