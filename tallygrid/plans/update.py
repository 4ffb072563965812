"""Build or update the stored tables from landed files."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..operators import clean, incremental
from ..operators.calendar import build_calendar, day_spine
from ..operators.weather import hourly_view, payload_rows, weather_view
from ..params import Params
from ..session import written
from ..sources import day_parts, reference_files, store
from ..sources.count_files import read_count_files
from ..sources.landing import listed, note, pending
from ..sources.schemas import HOLIDAYS

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Landing:
    """Folders and files where published data has been put."""

    archive: str | Sequence[str] | None = None
    live: str | Sequence[str] | None = None
    sensors: str | None = None
    weather: str | None = None
    holidays: str | None = None
    terms: str | None = None
    events: str | None = None


def update(
    spark: SparkSession, root: str, landing: Landing, today: date, params: Params = Params()
) -> DataFrame:
    """Load what is new, rebuild the small tables and views, return the summary by source.

    The archive is loaded once; live data and weather only for the windows that
    ``refresh_windows`` asks for.
    """
    day_parts.maintain(spark, root, params)
    newest = day_parts.summary(spark, root, params).select("source", F.col("last_date").alias("date"))
    plan = incremental.refresh_windows(
        newest, store.read_weather_hourly(spark, root), today
    ).first()
    if landing.archive and plan.fetch_archive:
        load_counts(spark, root, read_count_files(spark, landing.archive), fixed.ARCHIVE_SOURCE)
    if landing.live:
        load_live(spark, root, landing.live, plan.live_since)
    day_parts.maintain(spark, root, params)
    if landing.sensors:
        store.replace_table(
            spark, root, "sensors", reference_files.read_sensors(spark, landing.sensors)
        )
    if landing.weather and plan.fetch_weather:
        rows = payload_rows(
            reference_files.read_weather_payload(spark, landing.weather), params.time_zone
        ).where(
            F.to_date("ts_utc").between(F.lit(plan.weather_start), F.lit(plan.weather_end))
        )
        base = store.read_weather_hourly(spark, root)
        store.replace_table(
            spark, root, "weather_hourly", incremental.upsert_weather(base, rows)
        )
    store.replace_table(spark, root, "calendar", _calendar(spark, landing, plan, params))
    create_views(spark, root)
    return day_parts.summary(spark, root, params)


def load_counts(spark: SparkSession, root: str, rows: DataFrame, source: str) -> int:
    """Gate, clean and store one batch of typed rows; returns the rows kept.

    The batch is parsed once: gate and cleaning read the written copy. It is
    shuffled once: the conflict report is observed while the rows are stored.
    """
    return load_staged(spark, root, written(rows, "staged-counts"), source)


def load_live(
    spark: SparkSession, root: str, paths: str | Sequence[str], since: date | None
) -> int:
    """Load the live window from the landed files that have something for it."""
    load = pending(spark, root, fixed.LIVE_SOURCE, paths, since)
    if load is None:
        log.info("no landed live file changed")
        return 0
    if not load.files and not listed(spark, paths).isEmpty():
        note(spark, root, load, None)
        return 0
    rows = read_count_files(spark, load.files or paths, with_file=True)
    # unreadable dates stay in, for the gate to judge
    if since is not None:
        rows = rows.where(F.col("date").isNull() | (F.col("date") >= F.lit(since)))
    staged = written(rows, "staged-counts")
    kept = load_staged(spark, root, staged, fixed.LIVE_SOURCE)
    note(spark, root, load, staged)
    return kept


def load_staged(spark: SparkSession, root: str, staged: DataFrame, source: str) -> int:
    """``load_counts`` for a batch that is written already."""
    total = clean.check_quality(staged, source)
    if not total:
        log.info("no new %s rows", source)
        return 0
    rows_of_keys, report = clean.one_per_key_observed(staged)
    kept = store.append_counts(spark, root, rows_of_keys, source)
    conflicts = report.get
    if conflicts["keys"]:
        log.info(
            "dropped %s sensor-hours of %s with conflicting counts (%s to %s)",
            conflicts["keys"], source, conflicts["first_date"], conflicts["last_date"],
        )
    log.info("kept %s of %s %s rows", kept, total, source)
    return kept


def create_views(spark: SparkSession, root: str) -> None:
    """Temporary views for SQL users: counts, weather_hourly, weather, hourly."""
    counts = store.read_counts(spark, root)
    weather_hourly = store.read_weather_hourly(spark, root)
    weather = weather_view(weather_hourly)
    views = {
        "counts": counts.drop("month"),
        "weather_hourly": weather_hourly,
        "weather": weather,
        "hourly": hourly_view(counts, weather, measure=False),
    }
    for name in ("sensors", "calendar"):
        if store.has_table(spark, root, name):
            views[name] = store.read_table(spark, root, name)
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)


def _calendar(spark: SparkSession, landing: Landing, plan, params: Params) -> DataFrame:
    terms = (
        reference_files.read_terms(spark, landing.terms)
        if landing.terms
        else reference_files.known_terms(spark)
    )
    events = (
        reference_files.read_events(spark, landing.events)
        if landing.events
        else reference_files.known_events(spark)
    )
    holidays = (
        reference_files.read_holidays(spark, landing.holidays)
        if landing.holidays
        else spark.createDataFrame([], HOLIDAYS)
    )
    return build_calendar(
        day_spine(spark, plan.calendar_start, plan.calendar_end),
        holidays,
        terms,
        events,
        params.event_names,
    )
