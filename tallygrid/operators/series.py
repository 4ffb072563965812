"""Daily, weekly, monthly and yearly series, with gaps kept as gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import in_base, month_start, of_sensors, week_end
from ..functions.numbers import ratio
from ..params import Params


def indexed_series(counts: DataFrame, params: Params) -> DataFrame:
    """Mean index per day, each sensor first set to its own base-year mean = 100.

    Only whole days count. Counts shrink to one row per sensor-day, from which
    the base means are summed too, so the counts are read once.
    """
    days = of_sensors(counts, params).groupBy("sensor_id", "date").agg(
        F.sum("count").alias("total"), F.count("count").alias("known"), F.count("*").alias("rows")
    )
    base = (
        days.where(in_base(params))
        .groupBy("sensor_id")
        .agg(ratio(F.sum("total"), F.sum("known")).alias("base_mean"))
    )
    whole = days.where(F.col("rows") == params.slots_per_day)
    return (
        whole.withColumn("day_mean", ratio(F.col("total"), F.col("known")))
        .join(base, "sensor_id")
        .withColumn("own_index", ratio(100 * F.col("day_mean"), F.col("base_mean")))
        .groupBy("date")
        .agg(F.avg("own_index").alias("index"), F.count("*").alias("sensors"))
    )


def with_gaps(rows: DataFrame, axis: str, step: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows for every step between a series' first and last, ``value`` NULL where absent.

    Each row lists the steps up to the next one, so the series is read once and
    needs no join to a generated axis. The window sees one row per step and
    series: days, weeks or months of the whole history, never single counts.
    """
    following = F.lead(axis).over(Window.partitionBy(*keys).orderBy(axis))
    interval = F.expr(f"interval {step}")
    steps = F.filter(
        F.sequence(F.col(axis), F.coalesce("_next", axis), interval),
        lambda at: (at == F.col(axis)) | (at < F.col("_next")),
    )
    return (
        rows.withColumn("_next", following)
        .withColumn("_at", F.explode(steps))
        .select(
            *keys,
            F.col("_at").alias(axis),
            F.when(F.col("_at") == F.col(axis), F.col(value)).alias(value),
        )
    )


def smoothed_series(series: DataFrame, params: Params) -> DataFrame:
    """Trailing mean over the last days of a daily index; NULL where too few exist.

    Every day is handed to the days it counts for, so the mean is one grouping.
    """
    days = with_gaps(series.select("date", "index"), "date", "1 day", "index")
    spread = days.select(
        F.posexplode(
            F.sequence(
                F.col("date"),
                F.date_add("date", params.smooth_days - 1),
                F.expr("interval 1 day"),
            )
        ).alias("age", "date"),
        "index",
    )
    return (
        spread.groupBy("date")
        .agg(
            F.avg("index").alias("mean"),
            F.count("index").alias("days"),
            F.min("age").alias("youngest"),
        )
        .where(F.col("youngest") == 0)  # not past the last day
        .select(
            "date",
            F.when(F.col("days") >= params.smooth_min_days, F.col("mean")).alias("smooth"),
        )
    )


def yearly_index(series: DataFrame) -> DataFrame:
    """Mean index per year, rounded to whole points."""
    return series.groupBy(F.year("date").alias("year")).agg(
        F.round(F.avg("index"), 0).alias("index")
    )


def monthly_steps(counts: DataFrame, params: Params, sensors: tuple[int, ...] | None) -> DataFrame:
    """Mean daytime count per month of some sensors, missing months as NULL rows.

    Each sensor's axis runs from its first to its last month.
    """
    own = of_sensors(counts, params.with_(sensors=sensors))
    monthly = (
        own.where(F.col("hour").between(*params.daytime_hours))
        .groupBy("sensor_id", month_start("date").alias("month"))
        .agg(F.avg("count").alias("mean_count"))
    )
    return with_gaps(monthly, "month", "1 month", "mean_count", ("sensor_id",))


def whole_day_totals(counts: DataFrame, params: Params) -> DataFrame:
    """Daily total per sensor, days with every hour only."""
    return (
        of_sensors(counts, params)
        .groupBy("sensor_id", "date")
        .agg(F.sum("count").alias("people"), F.count("*").alias("rows"))
        .where(F.col("rows") == params.slots_per_day)
        .drop("rows")
    )


def weekly_history(counts: DataFrame, params: Params) -> DataFrame:
    """Weekly mean of whole-day totals per sensor; empty weeks stay as NULL rows.

    A week is labelled by the Sunday that ends it.
    """
    weekly = (
        whole_day_totals(counts, params)
        .groupBy("sensor_id", week_end("date").alias("week"))
        .agg(F.avg("people").alias("people"))
    )
    return with_gaps(weekly, "week", "7 day", "people", ("sensor_id",))
