"""The shape of day and week, and what weather does to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions.dates import day_type, in_base, in_recent, in_scope, period, weekday
from ..functions.numbers import ratio, right_closed
from ..params import Params


def hourly_profile(counts: DataFrame, params: Params) -> DataFrame:
    """Mean count by period, type of day and hour."""
    return (
        in_scope(counts, params)
        .groupBy(period(params).alias("period"), day_type("date").alias("day_type"), "hour")
        .agg(F.avg("count").alias("mean_count"))
    )


def weekday_level(counts: DataFrame, params: Params) -> DataFrame:
    """Mean count by weekday in both periods and the recent one as % of the base.

    ``position`` is 1 for Monday to 7 for Sunday.
    """
    number = weekday("date")
    return (
        in_scope(counts, params)
        .groupBy(number.alias("dow"))
        .agg(
            F.avg(F.when(in_base(params), F.col("count"))).alias("mean_base"),
            F.avg(F.when(in_recent(params), F.col("count"))).alias("mean_recent"),
        )
        .select(
            "dow",
            (F.pmod(F.col("dow") + 6, F.lit(7)) + 1).alias("position"),
            "mean_base",
            "mean_recent",
            ratio(100 * F.col("mean_recent"), F.col("mean_base")).alias("pct_of_base"),
        )
    )


def relative_to_median(hourly: DataFrame, params: Params) -> DataFrame:
    """Daytime counts relative to the median of their sensor, period, weekday, hour.

    With one row per sensor and hour of a date, such a group holds at most one
    row per week of the period, however large the table or the sensor.
    """
    usual = Window.partitionBy("sensor_id", "period", "dow", "hour")
    return (
        in_scope(hourly, params)
        .where(F.col("hour").between(*params.daytime_hours) & F.col("temperature").isNotNull())
        .withColumn("period", period(params))
        .withColumn("dow", weekday("date"))
        .withColumn("usual", F.median("count").over(usual))
        .withColumn("relative", ratio(F.col("count"), F.col("usual")))
        .where(F.col("relative").isNotNull())
        .drop("usual")
    )


def rain_effect(relative: DataFrame) -> DataFrame:
    """Mean relative count by rain in the hour."""
    return _effect(
        relative, right_closed("precipitation_mm", fixed.RAIN_EDGES, fixed.RAIN_LABELS)
    )


def temperature_effect(relative: DataFrame) -> DataFrame:
    """Mean relative count by temperature."""
    return _effect(
        relative,
        right_closed("temperature", fixed.TEMPERATURE_EDGES, fixed.TEMPERATURE_LABELS),
    )


def _effect(relative: DataFrame, bucket: Column) -> DataFrame:
    return (
        relative.select(bucket.alias("bucket"), "relative")
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.avg("relative").alias("mean_relative"), F.count("*").alias("hours"))
    )
