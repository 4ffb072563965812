"""Which sensors count when: coverage, selection, completeness, faults."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.dates import days_in_month, in_base, in_recent, month_start, of_sensors
from ..functions.joins import measured
from ..functions.numbers import ratio
from ..functions.text import mentions
from ..params import Params


def sensor_coverage(counts: DataFrame, sensors: DataFrame, params: Params) -> DataFrame:
    """Share of hours present and mean count, base year against recent period.

    The denominators are the periods' full lengths, also for sensors that were
    installed part-way.
    """
    base, recent = in_base(params), in_recent(params)
    spans = counts.groupBy("sensor_id").agg(
        (F.count_if(base) / F.lit(float(params.base_hours))).alias("cov_base"),
        (F.count_if(recent) / F.lit(float(params.recent_hours))).alias("cov_recent"),
        F.avg(F.when(base, F.col("count"))).alias("mean_base"),
        F.avg(F.when(recent, F.col("count"))).alias("mean_recent"),
    )
    places = sensors.select(
        F.col("location_id").alias("sensor_id"),
        F.col("sensor_description").alias("name"),
        "latitude",
        "longitude",
        "note",
    )
    return spans.withColumn(
        "recent_vs_base", ratio(F.col("mean_recent"), F.col("mean_base"))
    ).join(places, "sensor_id")


def well_covered(coverage: DataFrame, params: Params) -> DataFrame:
    """Sensors inside the study area with enough hours in both periods."""
    return coverage.where(
        F.col("latitude").between(*params.latitudes)
        & F.col("longitude").between(*params.longitudes)
        & (F.col("cov_base") >= params.min_coverage)
        & (F.col("cov_recent") >= params.min_coverage)
    )


def select_sensors(coverage: DataFrame, params: Params) -> DataFrame:
    """Well covered sensors; ``selected`` is false for moved or changed ones."""
    moved = F.col("sensor_id").isin(*params.moved_sensors)
    return well_covered(coverage, params).withColumn("selected", ~moved)


def monthly_completeness(counts: DataFrame, params: Params) -> DataFrame:
    """Hours present per sensor and month, as a count and a share."""
    hours = counts.groupBy("sensor_id", month_start("date").alias("month")).agg(
        F.count("*").alias("hours")
    )
    return with_share(hours, params)


def with_share(hours: DataFrame, params: Params) -> DataFrame:
    """Monthly hours and their share of the month's slots."""
    slots = days_in_month("month") * F.lit(params.slots_per_day)
    return hours.withColumn("share", F.col("hours") / slots)


def completeness_grid(
    monthly: DataFrame,
    first: date = fixed.GRID_FIRST_MONTH,
    last: date = fixed.GRID_LAST_MONTH,
) -> DataFrame:
    """One row per sensor, one column per month of a fixed range, oldest first.

    Columns exist for months nobody counted in; they stay NULL.
    """
    months = _months(first, last)
    in_range = F.col("month").between(F.lit(months[0]), F.lit(months[-1]))
    return (
        monthly.withColumn("label", F.date_format("month", "yyyy-MM"))
        .groupBy("sensor_id")
        .agg(
            F.min(F.when(in_range, F.col("month"))).alias("first_month"),
            *[
                F.max(F.when(F.col("label") == f"{m:%Y-%m}", F.col("share"))).alias(f"{m:%Y-%m}")
                for m in months
            ],
        )
        .orderBy(F.col("first_month").asc_nulls_last(), "sensor_id")
    )


def fault_days(counts: DataFrame, params: Params) -> DataFrame:
    """Sensor-days with enough daytime rows that are all zero: a dead sensor."""
    return (
        counts.where(F.col("hour").between(*params.daytime_hours))
        .groupBy("sensor_id", "date")
        .agg(F.count("*").alias("_daytime_rows"), F.max("count").alias("_daytime_max"))
        .where(is_fault(params))
        .select("sensor_id", "date")
    )


def is_fault(params: Params) -> Column:
    """The rule over a sensor-day's number of daytime rows and their highest count."""
    return (F.col("_daytime_rows") >= params.fault_min_rows) & (F.col("_daytime_max") == 0)


def faulty_days(totals: DataFrame, params: Params) -> DataFrame:
    """``fault_days`` from totals of sensor-days, which need no grouping."""
    return totals.where(is_fault(params)).select("sensor_id", "date")


def without_faults(
    counts: DataFrame, params: Params, faults: DataFrame | None = None
) -> DataFrame:
    """Counts of sensor-days that do not look like faults.

    Stored ``faults`` join as they are. Without them the list is made and
    measured first: while it is small, the counts need no shuffle to lose a few days.
    """
    if faults is None:
        faults = measured(fault_days(counts, params), "fault-days")
    return counts.join(faults, ["sensor_id", "date"], "left_anti")


def suspicious_days(counts: DataFrame, params: Params) -> DataFrame:
    """Fault days per sensor, most first."""
    return (
        fault_days(of_sensors(counts, params), params)
        .groupBy("sensor_id")
        .agg(F.count("*").alias("suspicious_days"))
        .orderBy(F.desc("suspicious_days"), "sensor_id")
    )


def upgrade_compare(selection: DataFrame, params: Params) -> DataFrame:
    """Recovery of upgraded against other sensors."""
    return (
        selection.groupBy(mentions("note", params.upgrade_word).alias("upgraded"))
        .agg(
            F.avg("recent_vs_base").alias("mean_ratio"),
            F.median("recent_vs_base").alias("median_ratio"),
            F.count("recent_vs_base").alias("sensors"),
        )
    )


def sensor_picker(sensors: DataFrame, params: Params) -> DataFrame:
    """Ids and names of the chosen sensors, by name."""
    return (
        of_sensors(sensors, params, "location_id")
        .select(F.col("location_id").alias("sensor_id"), F.col("sensor_description").alias("name"))
        .orderBy("name", "sensor_id")
    )


def _months(first: date, last: date) -> list[date]:
    span = (last.year - first.year) * 12 + last.month - first.month
    return [
        date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1)
        for i in range(span + 1)
    ]
