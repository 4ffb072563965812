"""Leakage-safe lag features and the model's feature table."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import between_days, of_sensors, weekday
from ..functions.joins import broadcast_up_to, days_between
from ..functions.numbers import ratio
from ..params import Params
from ..sources.schemas import COUNT_KEYS
from .calendar import event_column, with_holiday_neighbours
from .coverage import without_faults
from .season import with_season
from .weather import VIEW_COLUMNS

TIME_FEATURES = ("hour", "dow", "month", "doy")
SEASON_FEATURES = ("season", "season_change")


def calendar_features(params: Params) -> tuple[str, ...]:
    return (
        "is_holiday",
        "day_before_holiday",
        "day_after_holiday",
        "school_term",
        *[event_column(name) for name in params.event_names],
    )


def feature_names(params: Params) -> tuple[str, ...]:
    """All model inputs, in a stable order."""
    return (
        "sensor_id",
        *TIME_FEATURES,
        *calendar_features(params),
        *VIEW_COLUMNS,
        "baseline",
        *[f"lag_{lag}" for lag in (*params.single_lags, params.year_lag)],
        *SEASON_FEATURES,
    )


def lagged_counts(rows: DataFrame, lags: tuple[int, ...], value: str = "count") -> dict[int, Column]:
    """Expressions for the value of the same sensor and hour ``lag`` days before.

    One shuffle and one sort serve every lag. All lags are multiples of their
    greatest common divisor (a week), so the days also split by phase: even a
    sensor with a third of all rows spreads over 24 x 7 tasks, each with one
    row per week.
    """
    step = reduce(gcd, lags)
    day = F.unix_date("date")
    same_slot = Window.partitionBy("sensor_id", "hour", F.pmod(day, F.lit(step))).orderBy(day)
    return {
        lag: F.max(value).over(same_slot.rangeBetween(-lag, -lag)) for lag in lags
    }


def mean_of_known(values: list[Column]) -> tuple[Column, Column]:
    """Mean over the non-NULL values (NULL if none) and how many there are."""
    known = reduce(lambda a, b: a + b, [v.isNotNull().cast("bigint") for v in values])
    total = reduce(lambda a, b: a + b, [F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])
    return ratio(total, known), known


def seasonal_baseline(counts: DataFrame, start: date, end: date, params: Params) -> DataFrame:
    """Counts from ``start`` to ``end`` with the mean of the same hour 5-8 weeks before.

    Absent weeks are left out of the mean; ``baseline_weeks`` says how many
    were there. Fault days stay in.
    """
    lags = params.baseline_lags
    reach = between_days(of_sensors(counts, params), start - timedelta(max(lags)), end)
    past = lagged_counts(reach, lags)
    lagged = reach.select(*COUNT_KEYS, "count", *[past[lag].alias(f"_lag_{lag}") for lag in lags])
    baseline, weeks = mean_of_known([F.col(f"_lag_{lag}") for lag in lags])
    return lagged.where(F.col("date").between(F.lit(start), F.lit(end))).select(
        *COUNT_KEYS, "count", baseline.alias("baseline"), weeks.alias("baseline_weeks")
    )


def future_rows(sensors: DataFrame, start: date, end: date, params: Params) -> DataFrame:
    """Every hour of every day for each sensor, without a count.

    ``sensors`` has one row per sensor; days and hours come from exploded
    sequences, so there is no cross join.
    """
    hours = F.array(*[F.lit(h).cast("tinyint") for h in params.day_hours])
    return (
        sensors.select(F.col("sensor_id").cast("int"))
        .distinct()
        .withColumn(
            "date", F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day")))
        )
        .withColumn("hour", F.explode(hours))
        .withColumn("count", F.lit(None).cast("int"))
    )


def build_dataset(
    counts: DataFrame,
    calendar: DataFrame,
    weather: DataFrame,
    season: DataFrame,
    start: date,
    end: date,
    params: Params,
    future: DataFrame | None = None,
    faults: DataFrame | None = None,
) -> DataFrame:
    """One row per sensor and hour with every feature the model may use.

    Fault days are left out both as targets and as history. With ``future``
    (one row per sensor) the targets are the hours still to come, with an empty
    count. ``weather`` is the stored view or supplied weather of that shape.
    With stored ``faults`` (sensor_id, date) planning starts no job.
    """
    lags = params.all_lags
    own = of_sensors(counts, params)
    newest = end if future is None else end - timedelta(min(lags))
    reach = between_days(own, start - timedelta(max(lags)), newest)
    clean = without_faults(reach, params, faults).select(*COUNT_KEYS, "count")
    if future is None:
        rows = clean.select("*", F.col("count").alias("_past"), F.lit(True).alias("_target"))
    else:
        targets = future_rows(future, start, end, params)
        rows = clean.select(
            *COUNT_KEYS,
            F.lit(None).cast("int").alias("count"),
            F.col("count").alias("_past"),
            F.lit(False).alias("_target"),
        ).unionByName(
            targets.select("*", F.lit(None).cast("int").alias("_past"), F.lit(True).alias("_target"))
        )
    past = lagged_counts(rows, lags, "_past")
    lagged = rows.select(
        *COUNT_KEYS, "count", "_target", *[past[lag].alias(f"lag_{lag}") for lag in lags]
    )
    baseline, _ = mean_of_known([F.col(f"lag_{lag}") for lag in params.baseline_lags])
    in_range = F.col("date").between(F.lit(start), F.lit(end))
    targets = lagged.where(F.col("_target") & in_range).select(
        *COUNT_KEYS,
        "count",
        weekday("date").alias("dow"),
        F.month("date").alias("month"),
        F.dayofyear("date").alias("doy"),
        baseline.alias("baseline"),
        *[
            F.col(f"lag_{lag}").cast("double").alias(f"lag_{lag}")
            for lag in (*params.single_lags, params.year_lag)
        ],
    )
    days = days_between(start, end)
    flags = with_holiday_neighbours(calendar).where(in_range).select(
        "date",
        # yes, no or unknown as 1, 0 or NULL
        *[F.col(c).cast("int").cast("double").alias(c) for c in calendar_features(params)],
    )
    hours = weather.where(in_range).select("date", "hour", *VIEW_COLUMNS)
    # both are unique per day (and hour) of the range: their size is known here
    joined = targets.join(broadcast_up_to(flags, days), "date", "left").join(
        broadcast_up_to(hours, days * 24), ["date", "hour"], "left"
    )
    return with_season(joined, season, params).select(
        *COUNT_KEYS, "count", *[name for name in feature_names(params) if name not in COUNT_KEYS]
    )
