"""Windowed replacement, source precedence, refresh windows, summaries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..sources import schemas


def replace_window(base: DataFrame, batch: DataFrame, source: str) -> DataFrame:
    """``base`` with everything of ``source`` from the batch's first day replaced.

    An empty batch has no first day and therefore replaces nothing.
    """
    first = batch.agg(F.min("date")).scalar()
    replaced = F.coalesce(
        (F.col("source") == source) & (F.col("date") >= first), F.lit(False)
    )
    fresh = batch.withColumn("source", F.lit(source))
    return base.where(~replaced).unionByName(fresh)


def reconcile_sources(counts: DataFrame) -> DataFrame:
    """Drop archive rows from the first live day on; without live rows, drop none."""
    live_start = counts.where(F.col("source") == fixed.LIVE_SOURCE).agg(F.min("date")).scalar()
    superseded = F.coalesce(
        (F.col("source") == fixed.ARCHIVE_SOURCE) & (F.col("date") >= live_start), F.lit(False)
    )
    return counts.where(~superseded)


def upsert_weather(base: DataFrame, batch: DataFrame) -> DataFrame:
    """``base`` with all hours from the batch's first one on replaced.

    Measures the batch lacks become NULL.
    """
    first = batch.agg(F.min("ts_utc")).scalar()
    replaced = F.coalesce(F.col("ts_utc") >= first, F.lit(False))
    return base.where(~replaced).unionByName(weather_columns(batch))


def weather_columns(batch: DataFrame) -> DataFrame:
    """The weather table's columns in order, NULL where missing."""
    return batch.select(
        *[
            (F.col(f.name) if f.name in batch.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schemas.WEATHER_HOURLY
        ]
    )


def dataset_summary(counts: DataFrame) -> DataFrame:
    """Rows, sensors and date span of each source."""
    return counts.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.countDistinct("sensor_id").alias("sensors"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def weather_span(weather_hourly: DataFrame) -> DataFrame:
    return weather_hourly.agg(
        F.count("*").alias("hours"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def refresh_windows(counts: DataFrame, weather_hourly: DataFrame, today: date) -> DataFrame:
    """One row telling an update what to fetch.

    ``live_since`` is NULL for "everything"; ``fetch_weather`` is false when
    stored weather already reaches the publication lag.
    """
    spans = counts.agg(
        F.max(F.when(F.col("source") == fixed.ARCHIVE_SOURCE, F.col("date"))).alias("archive"),
        F.max(F.when(F.col("source") == fixed.LIVE_SOURCE, F.col("date"))).alias("live"),
    )
    last_weather = F.to_date(weather_hourly.agg(F.max("ts_utc")).scalar())
    weather_start = F.coalesce(
        F.date_sub(last_weather, fixed.WEATHER_OVERLAP_DAYS), F.lit(fixed.WEATHER_FIRST_DAY)
    )
    weather_end = F.date_sub(F.lit(today), fixed.WEATHER_LAG_DAYS)
    return spans.select(
        F.col("archive").isNull().alias("fetch_archive"),
        F.date_sub("live", fixed.LIVE_OVERLAP_DAYS).alias("live_since"),
        weather_start.alias("weather_start"),
        weather_end.alias("weather_end"),
        (weather_start <= weather_end).alias("fetch_weather"),
        F.lit(fixed.CALENDAR_FIRST_DAY).alias("calendar_start"),
        F.date_add(F.lit(today), fixed.CALENDAR_DAYS_AHEAD).alias("calendar_end"),
    )


def rows_since(landed: DataFrame, since: date | None) -> DataFrame:
    """Landed rows from ``since`` on, or all of them."""
    return landed if since is None else landed.where(F.col("date") >= F.lit(since))
