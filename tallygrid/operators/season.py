"""The typical level of each day of the year."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from ..fixed import SEASON_SMOOTH_DAYS
from ..functions.dates import between_days, of_sensors
from ..functions.numbers import ratio
from ..params import Params

YEAR_DAYS = 366


def relative_days(counts: DataFrame, params: Params) -> DataFrame:
    """Whole sensor-days of the season years relative to their sensor-year mean.

    The window works on day totals, at most 366 per sensor and year.
    """
    first, last = params.season_years
    own = between_days(of_sensors(counts, params), date(first, 1, 1), date(last, 12, 31))
    sensor_year = Window.partitionBy("sensor_id", F.year("date"))
    return (
        own.groupBy("sensor_id", "date")
        .agg(F.sum("count").alias("total"), F.count("*").alias("rows"))
        .where(F.col("rows") == params.slots_per_day)
        .select(
            "sensor_id",
            "date",
            F.dayofyear("date").alias("doy"),
            ratio(F.col("total"), F.avg("total").over(sensor_year)).alias("rel"),
        )
    )


def season_index(counts: DataFrame, params: Params) -> DataFrame:
    """366 rows: day of the year and its level (1 = average day), 7-day smoothed.

    Days without data are interpolated; smoothing runs around the year's end.
    """
    observed = relative_days(counts, params).groupBy("doy").agg(F.avg("rel").alias("level"))
    return _smooth_around_year(_interpolate(observed))


def _interpolate(observed: DataFrame) -> DataFrame:
    """Linear between known days; the last known level to the end of the year.

    Days before the first known one stay NULL. The ordered windows run over
    exactly 366 rows.
    """
    spark = observed.sparkSession
    year = spark.range(1, YEAR_DAYS + 1).select(F.col("id").cast("int").alias("doy"))
    before = Window.orderBy("doy").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("doy").rowsBetween(0, Window.unboundedFollowing)
    known_day = F.when(F.col("level").isNotNull(), F.col("doy"))
    around = year.join(observed, "doy", "left").select(
        "doy",
        F.last("level", ignorenulls=True).over(before).alias("low"),
        F.last(known_day, ignorenulls=True).over(before).alias("low_day"),
        F.first("level", ignorenulls=True).over(after).alias("high"),
        F.first(known_day, ignorenulls=True).over(after).alias("high_day"),
    )
    step = ratio(F.col("high") - F.col("low"), F.col("high_day") - F.col("low_day"))
    return around.select(
        "doy",
        F.coalesce(
            F.col("low") + step * (F.col("doy") - F.col("low_day")), F.col("low")
        ).alias("level"),
    )


def _smooth_around_year(levels: DataFrame) -> DataFrame:
    reach = SEASON_SMOOTH_DAYS // 2
    spread = levels.select(
        F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("step"), "doy", "level"
    ).select(
        (F.pmod(F.col("doy") + F.col("step") - 1, F.lit(YEAR_DAYS)) + 1).alias("doy"), "level"
    )
    return (
        spread.groupBy("doy")
        .agg(F.avg("level").alias("mean"), F.count("level").alias("known"))
        .select(
            "doy",
            F.when(F.col("known") == SEASON_SMOOTH_DAYS, F.col("mean")).alias("season"),
        )
    )


def season_table(season: DataFrame, params: Params) -> DataFrame:
    """Season and its change since the baseline's weeks, for each day of the year.

    The past level is the plain mean over the baseline lags, NULL if one is
    missing; days of the year wrap within 365.
    """
    lags = params.baseline_lags
    # 366 levels fit one map, which every row of the table then looks into
    levels = season.agg(
        F.map_from_entries(F.collect_list(F.struct("doy", "season"))).alias("levels")
    )
    rows = levels.select("levels", F.explode("levels").alias("doy", "season"))
    total = sum(
        (F.element_at("levels", F.pmod(F.col("doy") - lag - 1, F.lit(365)) + 1) for lag in lags),
        F.lit(0.0),
    )
    return rows.select(
        "doy", "season", ratio(F.col("season"), total / len(lags)).alias("season_change")
    )


def with_season(rows: DataFrame, season: DataFrame, params: Params) -> DataFrame:
    """Add ``season`` and ``season_change`` by day of the year."""
    table = F.broadcast(season_table(season, params))  # 366 rows whatever the data
    return rows.join(table, "doy", "left")
