"""Forecast errors: overall, by group, by slice, and the worst days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.joins import measured
from ..functions.numbers import ratio
from ..functions.text import signed_percent


def score(df: DataFrame, pred: str, by: str | Column | Sequence[str] | None = None) -> DataFrame:
    """MAE, WAPE (total error / total count) and rows, over rows with both values."""
    keys = [] if by is None else list(by) if isinstance(by, (list, tuple)) else [by]
    return _scored(df, pred).groupBy(*keys).agg(*_measures())


def _scored(df: DataFrame, pred: str) -> DataFrame:
    value = F.nanvl(F.col(pred).cast("double"), F.lit(None).cast("double"))
    return (
        df.withColumn("_pred", value)
        .where(F.col("_pred").isNotNull() & F.col("count").isNotNull())
        .withColumn("_error", F.abs(F.col("_pred") - F.col("count")))
    )


def _measures() -> list[Column]:
    return [
        F.avg("_error").alias("mae"),
        ratio(F.sum("_error"), F.sum("count")).alias("wape"),
        F.count("*").alias("hours"),
    ]


def compare_models(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors of baseline and model on the hours that have a baseline.

    Both are scored in one pass; ``reduction`` is the model's cut in MAE.
    """
    error_b = F.abs(F.col("baseline") - F.col("count"))
    error_m = F.abs(F.col("model") - F.col("count"))
    both = results.where(
        F.col("baseline").isNotNull() & F.col("model").isNotNull() & F.col("count").isNotNull()
    )
    return (
        both.groupBy(*by)
        .agg(
            F.avg(error_b).alias("baseline_mae"),
            F.avg(error_m).alias("model_mae"),
            ratio(F.sum(error_b), F.sum("count")).alias("baseline_wape"),
            ratio(F.sum(error_m), F.sum("count")).alias("model_wape"),
            F.count("*").alias("hours"),
        )
        .withColumn("reduction", 1 - ratio(F.col("model_mae"), F.col("baseline_mae")))
    )


def score_slices(results: DataFrame) -> DataFrame:
    """Baseline and model WAPE for all hours, normal days, holidays, heat and rain.

    Slices overlap: each row lists those it belongs to. The day's highest
    temperature is aggregated and joined back, as a window by date would put
    every sensor's rows of a day into one task.
    """
    compared = results.where(F.col("baseline").isNotNull())
    hottest = compared.groupBy("date").agg(F.max("temperature").alias("day_max_temp"))
    labelled = compared.join(measured(hottest, "hottest"), "date", "left")
    holiday = F.col("is_holiday").cast("boolean")
    slices = F.array_compact(
        F.array(
            F.lit("All hours"),
            F.when(~holiday, "Normal days"),
            F.when(holiday, "Public holidays"),
            F.when(F.col("day_max_temp") >= fixed.HOT_DAY_DEGREES, "Hot days (35°C+)"),
            F.when(F.col("precipitation_mm") >= fixed.RAINY_HOUR_MM, "Rainy hours (1 mm+)"),
        )
    )
    return (
        labelled.withColumn("slice", F.explode(slices))
        .groupBy("slice")
        .agg(
            _wape("baseline").alias("baseline_wape"),
            _wape("model").alias("model_wape"),
            F.count("*").alias("hours"),
        )
    )


def _wape(pred: str) -> Column:
    usable = F.col(pred).isNotNull() & F.col("count").isNotNull()
    error = F.when(usable, F.abs(F.col(pred) - F.col("count")))
    return ratio(F.sum(error), F.sum(F.when(usable, F.col("count"))))


def worst_baseline_days(
    baseline: DataFrame,
    weather: DataFrame,
    calendar: DataFrame,
    top: int = fixed.WORST_BASELINE_DAYS,
) -> DataFrame:
    """The days with the largest baseline WAPE, with weather and holiday."""
    days = (
        baseline.where(F.col("baseline").isNotNull())
        .groupBy("date")
        .agg(
            F.sum("count").alias("actual"),
            F.sum("baseline").alias("baseline"),
            ratio(
                F.sum(F.abs(F.col("baseline") - F.col("count"))), F.sum("count")
            ).alias("wape"),
        )
    )
    daily_weather = weather.groupBy("date").agg(
        F.max("temperature").alias("max_temp"), F.sum("precipitation_mm").alias("rain_mm")
    )
    change = ratio(F.col("actual"), F.col("baseline")) - 1
    return (
        days.join(daily_weather, "date")
        .join(calendar.select("date", "holiday_name"), "date")
        .select(
            "date",
            F.date_format("date", "EEEE").alias("weekday"),
            change.alias("change"),
            signed_percent(change).alias("actual_vs_baseline"),
            "wape",
            "max_temp",
            "rain_mm",
            "holiday_name",
        )
        .orderBy(F.desc_nulls_last("wape"), "date")
        .limit(top)
    )


def worst_model_days(
    results: DataFrame,
    calendar: DataFrame,
    top: int = fixed.WORST_MODEL_DAYS,
    min_total: int = fixed.WORST_MODEL_MIN_TOTAL,
) -> DataFrame:
    """The busy days with the largest model WAPE."""
    error = {p: F.abs(F.col(p) - F.col("count")) for p in ("model", "baseline")}
    change = ratio(F.col("predicted"), F.col("actual")) - 1
    return (
        results.where(F.col("baseline").isNotNull())
        .groupBy("date")
        .agg(
            F.sum("count").alias("actual"),
            F.sum("model").alias("predicted"),
            F.sum(error["model"]).alias("model_error"),
            F.sum(error["baseline"]).alias("baseline_error"),
            F.max("temperature").alias("max_temp"),
            F.max("precipitation_mm").alias("max_rain_mm"),
        )
        .where(F.col("actual") > min_total)
        .join(calendar.select("date", "holiday_name"), "date", "left")
        .select(
            "date",
            change.alias("change"),
            signed_percent(change).alias("model_vs_actual"),
            F.round(ratio(F.col("model_error"), F.col("actual")), 2).alias("model_wape"),
            F.round(ratio(F.col("baseline_error"), F.col("actual")), 2).alias("baseline_wape"),
            "max_temp",
            "max_rain_mm",
            "holiday_name",
        )
        .orderBy(F.desc_nulls_last("model_wape"), "date")
        .limit(top)
    )


def sensor_week(rows: DataFrame, sensor: int, start, end) -> DataFrame:
    """One sensor's hours in a span of days, with a timestamp for plotting."""
    stamp = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour").cast("int"))
    return rows.where(
        (F.col("sensor_id") == sensor) & F.col("date").between(F.lit(start), F.lit(end))
    ).withColumn("ts", stamp)
