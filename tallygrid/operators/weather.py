"""Weather by local hour, its join to the counts, and stand-in weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed import (
    LOCAL_TIME_ZONE,
    SUMMED_WEATHER,
    SUPPLIED_WEATHER_MIN_HOURS,
    TYPICAL_WEATHER_DAYS,
    WEATHER_VIEW_COLUMNS,
)
from ..functions.joins import measured

MEASURES = tuple(WEATHER_VIEW_COLUMNS)
VIEW_COLUMNS = tuple(WEATHER_VIEW_COLUMNS.values())


def payload_rows(payload: DataFrame, time_zone: str = LOCAL_TIME_ZONE) -> DataFrame:
    """Parallel arrays of a weather response as one row per UTC hour."""
    hourly = payload.select("hourly.*").where(F.col("time").isNotNull())
    zipped = F.arrays_zip(
        "time",
        *[
            # a measure missing from the response must not swallow the hours
            F.coalesce(F.col(m), F.transform("time", lambda _: F.lit(None).cast("double"))).alias(m)
            for m in MEASURES
        ],
    )
    rows = hourly.select(F.inline(zipped))
    rows = rows.withColumn("ts_utc", F.col("time").cast("timestamp_ntz"))
    return local_hours(rows, time_zone)


def local_hours(utc_rows: DataFrame, time_zone: str = LOCAL_TIME_ZONE) -> DataFrame:
    """Add local date and hour to rows stamped with ``ts_utc``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), F.col("ts_utc"))
    rows = utc_rows.withColumn("_local", local)
    return rows.select(
        "ts_utc",
        F.to_date("_local").alias("date"),
        F.hour("_local").cast("tinyint").alias("hour"),
        *[m for m in MEASURES if m in utc_rows.columns],
    )


def weather_view(weather_hourly: DataFrame) -> DataFrame:
    """One row per local date and hour.

    The hour repeated when daylight saving ends is averaged, its rain summed.
    """
    return weather_hourly.groupBy("date", "hour").agg(
        *[
            (F.sum(m) if m in SUMMED_WEATHER else F.avg(m)).alias(name)
            for m, name in WEATHER_VIEW_COLUMNS.items()
        ]
    )


def hourly_view(counts: DataFrame, weather: DataFrame, measure: bool = True) -> DataFrame:
    """Counts with the weather of their hour, NULL where none is stored.

    Weather has one row per hour whatever the number of sensors. ``measure``
    writes it and broadcasts it if it is small, which leaves the counts where
    they are; without it nothing is written, so the view follows its tables.
    """
    hours = weather.select("date", "hour", *VIEW_COLUMNS)
    if measure:
        hours = measured(hours, "weather")
    return (
        counts.select("sensor_id", "date", "hour", "count")
        .join(hours, ["date", "hour"], "left")
        .select("sensor_id", "date", "hour", "count", *VIEW_COLUMNS)
    )


def typical_weather(
    weather: DataFrame, dates: DataFrame, reach: int = TYPICAL_WEATHER_DAYS
) -> DataFrame:
    """Mean weather by hour over the days within ``reach`` days of the year.

    The band becomes an equi join: each wanted date lists its days of the year.
    The band does not wrap at the end of the year.
    """
    wanted = dates.select("date").distinct().select(
        "date",
        F.explode(
            F.sequence(F.dayofyear("date") - reach, F.dayofyear("date") + reach)
        ).alias("doy"),
    )
    # sums and counts by day of year first: years of history shrink to 366 x 24 rows
    by_doy = (
        weather.groupBy(F.dayofyear("date").alias("doy"), "hour")
        .agg(
            *[F.sum(c).alias(f"{c}_sum") for c in VIEW_COLUMNS],
            *[F.count(c).alias(f"{c}_n") for c in VIEW_COLUMNS],
        )
    )
    return (
        wanted.join(by_doy, "doy")
        .groupBy("date", "hour")
        .agg(
            *[
                F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c)
                for c in VIEW_COLUMNS
            ]
        )
    )


def choose_weather(
    supplied: DataFrame, typical: DataFrame, min_hours: int = SUPPLIED_WEATHER_MIN_HOURS
) -> DataFrame:
    """Supplied weather for days that have enough hours of it, typical elsewhere."""
    enough = (
        supplied.groupBy("date")
        .agg(F.count("*").alias("hours"))
        .where(F.col("hours") >= min_hours)
        .select("date")
    )
    columns = ["date", "hour", *VIEW_COLUMNS]
    taken = supplied.join(enough, "date", "left_semi").select(
        *columns, F.lit("supplied").alias("weather_source")
    )
    filled = typical.join(enough, "date", "left_anti").select(
        *columns, F.lit("typical").alias("weather_source")
    )
    return taken.unionByName(filled)
