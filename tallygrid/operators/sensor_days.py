"""Sensor-days for the then-vs-now comparison, and the type of each sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.dates import in_base, in_recent, in_scope, iso_week, period, weekday_name
from ..functions.joins import broadcast_up_to, days_between
from ..functions.numbers import ratio
from ..params import Params
from .coverage import is_fault


def sensor_days(counts: DataFrame, calendar: DataFrame, params: Params) -> DataFrame:
    """Whole, working, non-holiday sensor-days with totals per time window.

    Fault days fall out of the same grouping that builds the totals, so the
    counts are read and shuffled once. Days without a calendar row drop out.
    """
    return working_days(day_totals(in_scope(counts, params), params), calendar, params)


def day_totals(counts: DataFrame, params: Params) -> DataFrame:
    """Per sensor-day its totals by window, its rows and what tells a fault."""
    daytime = F.col("hour").between(*params.daytime_hours)
    return counts.groupBy("sensor_id", "date").agg(
        *[
            F.sum(F.when(F.col("hour").between(a, b), F.col("count"))).alias(name)
            for name, (a, b) in params.windows.items()
        ],
        F.count("*").alias("_rows"),
        F.count_if(daytime).alias("_daytime_rows"),
        F.max(F.when(daytime, F.col("count"))).alias("_daytime_max"),
    )


def working_days(totals: DataFrame, calendar: DataFrame, params: Params) -> DataFrame:
    """``sensor_days`` from totals of sensor-days, just summed or stored."""
    in_periods = in_base(params) | in_recent(params)
    working = calendar.where(in_periods & ~F.col("is_holiday")).select("date")
    # one row per day of the two periods: their length bounds the broadcast
    days = days_between(params.base_start, params.base_end) + days_between(
        params.recent_start, params.recent_end
    )
    return (
        in_scope(totals, params)
        .where((F.col("_rows") == params.slots_per_day) & ~F.coalesce(is_fault(params), F.lit(False)))
        .join(broadcast_up_to(working, days), "date")
        .select(
            "sensor_id",
            "date",
            *params.windows,
            period(params).alias("period"),
            weekday_name("date").alias("dow"),
            F.month("date").alias("month"),
            iso_week("date").alias("week"),
        )
    )


def period_counts(days: DataFrame) -> DataFrame:
    """Sensor-days per period."""
    return days.groupBy("period").agg(F.count("*").alias("sensor_days"))


def classify_sensors(days: DataFrame, params: Params) -> DataFrame:
    """Weekday-to-weekend ratio in the base year and the class it implies.

    A sensor without a ratio is not an office sensor.
    """
    weekend = F.col("dow").isin("Sat", "Sun")
    level = ratio(
        F.avg(F.when(~weekend, F.col("daily"))), F.avg(F.when(weekend, F.col("daily")))
    )
    return (
        days.where(F.col("period") == params.base_label)
        .groupBy("sensor_id")
        .agg(level.alias("weekday_vs_weekend"))
        .withColumn(
            "type",
            F.when(
                F.col("weekday_vs_weekend") >= params.office_ratio, fixed.OFFICE_CLASS
            ).otherwise(fixed.RETAIL_CLASS),
        )
        .orderBy("weekday_vs_weekend", "sensor_id")
    )


def with_sensor_type(days: DataFrame, types: DataFrame) -> DataFrame:
    """Sensor-days with their sensor's class; sensors never classed are retail."""
    return days.join(types.select("sensor_id", "type"), "sensor_id", "left").withColumn(
        "type", F.coalesce("type", F.lit(fixed.RETAIL_CLASS))
    )
