"""One named query per operation, over the whole test tables.

Values that depend on the order of floating-point sums are rounded when
delivered; the operators themselves never round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid import fixed
from tallygrid.functions.dates import in_scope
from tallygrid.functions.joins import measured
from tallygrid.operators import calendar as cal
from tallygrid.operators import clean, coverage, features, incremental, model, profiles, recovery
from tallygrid.operators import scoring, season, sensor_days as sd, series, weather
from tallygrid.operators.model import TreeSettings
from tallygrid.plans import analysis, forecast
from tallygrid.plans import tables as t
from tallygrid.plans.update import Landing, create_views, update
from tallygrid.session import shared_dir, written
from tallygrid.sources import day_parts, reference_files as files, store
from tallygrid.sources.count_files import read_count_files, typed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GRID_SPAN = (date(1995, 1, 1), date(2001, 11, 1))
BATCH_START = date(2000, 6, 1)
TODAY = date(2002, 1, 10)
DIGITS = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(
        *[
            # adding zero turns -0.0 into 0.0
            (F.round(c, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c)
            for c in df.columns
        ]
    )


# --- ingest and cleaning ---------------------------------------------------------


@cache
def span(spark, d):
    """First and last date of the stored counts."""
    return tuple(t.stored_counts(spark, d).agg(F.min("date"), F.max("date")).first())


def coming_days(spark, d):
    """The two weeks behind the newest count."""
    newest = span(spark, d)[1]
    return newest + timedelta(1), newest + timedelta(14)


def plain_counts(spark, d):
    return t.stored_counts(spark, d).drop("month")


@query
def build_counts(spark, d):
    return t.ship_counts(spark, d)


def raw(spark, d):
    return typed_counts(t.raw_counts(spark, d))


@query
def clean_counts(spark, d):
    return clean.one_per_key(raw(spark, d))


@query
def clean_archive_counts(spark, d):
    return clean.one_per_key(typed_counts(t.archive_text(spark, d)))


def as_files(spark, rows, name):
    """The rows as CSV files in the shared folder, the way the service publishes them."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return folder


@query
def csv_portal_counts(spark, d):
    """Text files of the portal layout, written, found, read and cleaned."""
    files = as_files(spark, t.raw_counts(spark, d), "portal-files")
    return clean.one_per_key(read_count_files(spark, files))


@query
def csv_archive_counts(spark, d):
    """Text files of the archive layout."""
    files = as_files(spark, t.archive_text(spark, d), "archive-files")
    return clean.one_per_key(read_count_files(spark, files))


@query
def csv_mixed_order(spark, d):
    """Files whose columns stand in different orders, and dates and numbers with blanks or slashes."""
    rows = t.raw_counts(spark, d)
    odd = F.col("location_id").cast("int") % 2 == 1
    turned = rows.where(odd).select(
        F.lit("x").alias("Note"),
        F.col("pedestriancount").alias("PedestrianCount"),
        F.concat(F.lit(" "), "hourday", F.lit(" ")).alias("HourDay"),
        F.concat(F.lit(" "), F.translate("sensing_date", "-", "/")).alias("Sensing Date"),
        F.col("location_id").alias("Location ID"),
    )
    folders = [as_files(spark, rows.where(~odd), "even-files"), as_files(spark, turned, "odd-files")]
    return clean.one_per_key(read_count_files(spark, folders))


def stored_root(spark, d):
    """A store that ``update`` built from files: counts of both layouts, sensors, holidays, terms, events.

    The archive files span the whole time, so that live data must hide their later part.
    """
    counts = t.ship_counts(spark, d)
    moment = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour").cast("int"))
    archive = counts.select(
        "sensor_id",
        F.date_format(moment, "MMMM dd, yyyy hh:mm:ss a").alias("date_time"),
        F.col("count").alias("hourly_counts"),
    )
    live = counts.where(F.col("source") == fixed.LIVE_SOURCE).select(
        F.col("sensor_id").alias("location_id"),
        F.col("date").alias("sensing_date"),
        F.col("hour").alias("hourday"),
        F.col("count").alias("pedestriancount"),
    )
    landing = Landing(
        archive=as_files(spark, archive, "archive-files"),
        live=as_files(spark, live, "live-files"),
        sensors=as_files(spark, t.sensors(spark, d), "sensor-files"),
        holidays=as_files(spark, t.holidays(spark, d), "holiday-files"),
        terms=as_files(spark, t.terms(spark, d), "term-files"),
        events=as_files(spark, t.events(spark, d), "event-files"),
    )
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    update(spark, root, landing, TODAY, t.SHIP)
    return root


_roots: dict[tuple[str, str], str] = {}


def one_root(spark, d):
    """The store of this application, built on first use."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _roots:
        _roots[key] = stored_root(spark, d)
    return _roots[key]


@query
def stored_update(spark, d):
    """Counts as the store shows them after an update from files of both layouts."""
    return store.read_counts(spark, one_root(spark, d)).drop("month")


@query
def stored_summary(spark, d):
    """Rows, distinct sensors and span of each source from the parts of the loads."""
    return day_parts.summary(spark, one_root(spark, d), t.SHIP)


@query
def stored_fault_days(spark, d):
    """Fault days as the loads left them, without those that later loads hide."""
    return day_parts.read_faults(spark, one_root(spark, d), t.SHIP)


@query
def stored_completeness(spark, d):
    hours = day_parts.read_monthly(spark, one_root(spark, d), t.SHIP)
    return rounded(coverage.with_share(hours, t.SHIP))


@query
def stored_sensor_days(spark, d):
    """The sensor-days of the recovery study from stored totals, without a grouping."""
    totals = day_parts.read_days(spark, one_root(spark, d), t.SHIP)
    return sd.working_days(totals, t.stored_calendar(spark, d), t.SHIP)


@query
def sensors_file(spark, d):
    """Sensors as read from their file, with types taken from the text."""
    return store.read_table(spark, one_root(spark, d), "sensors")


@query
def reference_files(spark, d):
    """The calendar of all days, from files of holidays, terms and events."""
    paths = {
        name: as_files(spark, make(spark, d), name)
        for name, make in (("holidays", t.holidays), ("terms", t.terms), ("events", t.events))
    }
    days = cal.days_spanned(plain_counts(spark, d), ahead=fixed.CALENDAR_DAYS_AHEAD)
    found = cal.build_calendar(
        days,
        files.read_holidays(spark, paths["holidays"]),
        files.read_terms(spark, paths["terms"]),
        files.read_events(spark, paths["events"]),
        t.EVENT_NAMES,
    )
    return found.withColumn("school_term", F.col("school_term").cast("int").cast("double"))


@query
def calendar_table(spark, d):
    """The calendar read back from the store, where it replaced the one of the update."""
    root = one_root(spark, d)
    store.replace_table(spark, root, "calendar", t.calendar(spark, d))
    found = store.read_table(spark, root, "calendar")
    return found.withColumn("school_term", F.col("school_term").cast("int").cast("double"))


@query
def hourly_sql(spark, d):
    """What an SQL user sees under the names of the views, after weather has been stored."""
    root = one_root(spark, d)
    store.replace_table(spark, root, "weather_hourly", t.ship_weather(spark, d))
    create_views(spark, root)
    return rounded(spark.sql("SELECT * FROM hourly"))


@query
def conflict_report(spark, d):
    return clean.conflict_report(raw(spark, d))


@query
def quality_gate_counts(spark, d):
    return clean.quality_counts(raw(spark, d))


@query
def replace_window(spark, d):
    counts = plain_counts(spark, d)
    batch = (
        counts.where((F.col("source") == fixed.LIVE_SOURCE) & (F.col("date") >= F.lit(BATCH_START)))
        .withColumn("count", F.col("count") + 1)
        .drop("source")
    )
    return incremental.replace_window(counts, batch, fixed.LIVE_SOURCE)


@query
def reconcile_sources(spark, d):
    counts = plain_counts(spark, d)
    archive = counts.withColumn("source", F.lit(fixed.ARCHIVE_SOURCE))
    live = counts.where(F.col("source") == fixed.LIVE_SOURCE)
    return incremental.reconcile_sources(archive.unionByName(live))


@query
def dataset_summary(spark, d):
    return incremental.dataset_summary(plain_counts(spark, d))


@query
def weather_span(spark, d):
    return incremental.weather_span(t.stored(spark, d, t.ship_weather))


@query
def refresh_plan(spark, d):
    return incremental.refresh_windows(plain_counts(spark, d), t.stored(spark, d, t.ship_weather), TODAY)


@query
def live_since(spark, d):
    return incremental.rows_since(plain_counts(spark, d), BATCH_START)


# --- weather ---------------------------------------------------------------------


@query
def weather_local(spark, d):
    return t.ship_weather(spark, d)


@query
def weather_payload(spark, d):
    return weather.payload_rows(t.weather_payload(spark, d))


@query
def weather_by_local_hour(spark, d):
    return rounded(t.ship_weather_view(spark, d))


@query
def hourly_joined(spark, d):
    view = weather.weather_view(t.stored(spark, d, t.web_weather))
    return rounded(weather.hourly_view(t.event_counts(spark, d), view))


@query
def weather_upsert(spark, d):
    base = t.stored(spark, d, t.ship_weather)
    batch = (
        base.where(F.col("ts_utc") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
        .withColumn("temperature_2m", F.col("temperature_2m") + 1)
        .drop("wind_speed_10m")
    )
    return incremental.upsert_weather(base, batch)


@query
def typical_weather(spark, d):
    return rounded(
        weather.typical_weather(t.stored_weather(spark, d), t.holidays(spark, d))
    )


@query
def weather_choice(spark, d):
    view = t.stored_weather(spark, d)
    days = t.holidays(spark, d).select("date")
    supplied = view.join(days, "date", "left_semi")
    return rounded(
        weather.choose_weather(supplied, weather.typical_weather(view, days), min_hours=6)
    )


# --- calendar --------------------------------------------------------------------


@query
def calendar(spark, d):
    # the three-valued term as 1, 0 or NULL
    return t.calendar(spark, d).withColumn(
        "school_term", F.col("school_term").cast("int").cast("double")
    )


@query
def odd_calendar(spark, d):
    """Events that no list names, two holidays on a day, an interval that ends before it starts."""
    days = t.stored(spark, d, t.odd_calendar)
    return days.withColumn("school_term", F.col("school_term").cast("double"))


@query
def holiday_neighbours(spark, d):
    return cal.with_holiday_neighbours(t.stored_calendar(spark, d)).select(
        "date", "is_holiday", "day_before_holiday", "day_after_holiday"
    )


@query
def holiday_lookup(spark, d):
    return cal.holiday_on(t.stored_calendar(spark, d), date(2000, 12, 25))


# --- coverage --------------------------------------------------------------------


def coverage_rows(spark, d):
    return coverage.sensor_coverage(t.stored_counts(spark, d), t.sensors(spark, d), t.SHIP)


@query
def sensor_coverage(spark, d):
    return rounded(coverage_rows(spark, d))


@query
def sensor_selection(spark, d):
    return rounded(coverage.select_sensors(coverage_rows(spark, d), t.SHIP))


@query
def monthly_completeness(spark, d):
    return rounded(coverage.monthly_completeness(t.stored_counts(spark, d), t.SHIP))


@query
def completeness_grid(spark, d):
    monthly = coverage.monthly_completeness(t.stored_counts(spark, d), t.SHIP)
    return rounded(coverage.completeness_grid(monthly, *GRID_SPAN))


@query
def fault_days(spark, d):
    return coverage.fault_days(t.stored_counts(spark, d), t.SHIP)


@query
def suspicious_days(spark, d):
    return coverage.suspicious_days(t.stored_counts(spark, d), t.SHIP)


@query
def upgrade_compare(spark, d):
    selection = coverage.select_sensors(coverage_rows(spark, d), t.SHIP)
    return rounded(coverage.upgrade_compare(selection.where("selected"), t.SHIP))


@query
def sensor_picker(spark, d):
    return coverage.sensor_picker(t.sensors(spark, d), t.SHIP)


# --- series and profiles ---------------------------------------------------------


def index_rows(spark, d):
    return series.indexed_series(t.stored_counts(spark, d), t.SHIP)


@query
def indexed_series(spark, d):
    return rounded(index_rows(spark, d))


@query
def smoothed_series(spark, d):
    return rounded(series.smoothed_series(index_rows(spark, d), t.SHIP))


@query
def yearly_index(spark, d):
    return series.yearly_index(index_rows(spark, d))


@query
def monthly_steps(spark, d):
    return rounded(series.monthly_steps(t.stored_counts(spark, d), t.SHIP, sensors=None))


@query
def weekly_history(spark, d):
    return rounded(series.weekly_history(t.stored_counts(spark, d), t.SHIP))


@query
def hourly_profile(spark, d):
    return rounded(profiles.hourly_profile(t.stored_counts(spark, d), t.SHIP))


@query
def weekday_level(spark, d):
    return rounded(profiles.weekday_level(t.stored_counts(spark, d), t.SHIP))


def relative_rows(spark, d):
    # scoped before the join, while the counts still carry their month
    scoped = in_scope(t.stored_counts(spark, d), t.SHIP)
    hourly = weather.hourly_view(scoped, t.stored_weather(spark, d))
    return profiles.relative_to_median(hourly, t.SHIP)


@query
def relative_to_median(spark, d):
    return rounded(relative_rows(spark, d))


@query
def rain_effect(spark, d):
    return rounded(profiles.rain_effect(relative_rows(spark, d)))


@query
def temperature_effect(spark, d):
    return rounded(profiles.temperature_effect(relative_rows(spark, d)))


# --- forecast features and scores ------------------------------------------------


def baseline_rows(spark, d):
    return features.seasonal_baseline(t.stored_counts(spark, d), *span(spark, d), t.SHIP)


@query
def seasonal_baseline(spark, d):
    return rounded(baseline_rows(spark, d))


@query
def season_index(spark, d):
    return rounded(season.season_index(t.stored_counts(spark, d), t.SHIP))


@query
def season_features(spark, d):
    index = season.season_index(t.stored_counts(spark, d), t.SHIP)
    return rounded(season.season_table(index, t.SHIP))


def dataset_rows(spark, d):
    counts = t.stored_counts(spark, d)
    return features.build_dataset(
        counts,
        t.stored_calendar(spark, d),
        t.stored_weather(spark, d),
        season.season_index(counts, t.SHIP),
        *span(spark, d),
        t.SHIP,
        faults=t.stored_faults(spark, d),
    )


@query
def feature_dataset(spark, d):
    return rounded(dataset_rows(spark, d))


def future_rows(spark, d):
    counts = t.stored_counts(spark, d)
    view = t.stored_weather(spark, d)
    days = cal.day_spine(spark, *coming_days(spark, d))
    return features.build_dataset(
        counts,
        t.stored_calendar(spark, d),
        weather.typical_weather(view, days),
        season.season_index(counts, t.SHIP),
        *coming_days(spark, d),
        t.SHIP,
        future=t.sensors(spark, d).withColumnRenamed("location_id", "sensor_id"),
        faults=t.stored_faults(spark, d),
    )


@query
def future_dataset(spark, d):
    return rounded(future_rows(spark, d).withColumn("count", F.col("count").cast("double")))


@query
def day_ahead_summary(spark, d):
    """The whole-day summary with the count of five weeks ago as the forecast."""
    predicted = future_rows(spark, d).withColumn("model", F.col("lag_35"))
    return rounded(model.day_ahead(predicted, t.stored_calendar(spark, d)))


@query
def score_overall(spark, d):
    return rounded(scoring.score(baseline_rows(spark, d), "baseline"))


@query
def score_by_sensor(spark, d):
    return rounded(scoring.score(baseline_rows(spark, d), "baseline", "sensor_id"))


@query
def score_by_month(spark, d):
    month = F.date_format("date", "yyyy-MM").alias("month")
    return rounded(scoring.score(baseline_rows(spark, d), "baseline", month))


@query
def score_by_holiday(spark, d):
    days = measured(t.stored_calendar(spark, d).select("date", "is_holiday"), "holidays")
    rows = baseline_rows(spark, d).join(days, "date", "left")
    return rounded(scoring.score(rows, "baseline", "is_holiday"))


def compared_rows(spark, d):
    """Feature rows with last year's count (else five weeks ago) as the model."""
    return dataset_rows(spark, d).withColumn(
        "model", F.coalesce("lag_364", "lag_35").cast("double")
    )


@query
def model_comparison(spark, d):
    return rounded(scoring.compare_models(compared_rows(spark, d)))


@query
def model_comparison_by_sensor(spark, d):
    names = t.sensors(spark, d).select(
        F.col("location_id").alias("sensor_id"), F.col("sensor_description").alias("name")
    )
    scores = scoring.compare_models(compared_rows(spark, d), ["sensor_id"])
    return rounded(scores.join(names, "sensor_id", "left"))


@query
def model_comparison_by_month(spark, d):
    month = F.date_format("date", "yyyy-MM").alias("month")
    return rounded(scoring.compare_models(compared_rows(spark, d), [month]))


@query
def model_comparison_by_holiday(spark, d):
    return rounded(scoring.compare_models(compared_rows(spark, d), ["is_holiday"]))


@query
def score_slices(spark, d):
    # used twice by the report, as a stored back-test would be
    return rounded(scoring.score_slices(written(compared_rows(spark, d), "compared")))


@query
def worst_baseline_days(spark, d):
    return rounded(
        scoring.worst_baseline_days(
            baseline_rows(spark, d), t.stored_weather(spark, d), t.stored_calendar(spark, d)
        )
    )


@query
def worst_model_days(spark, d):
    return rounded(
        scoring.worst_model_days(compared_rows(spark, d), t.stored_calendar(spark, d), min_total=300)
    )


@query
def sensor_week(spark, d):
    rows = scoring.sensor_week(baseline_rows(spark, d), 0, date(2000, 1, 24), date(2000, 1, 30))
    return rounded(rows)


# --- then and now ----------------------------------------------------------------


def day_rows(spark, d):
    return sd.sensor_days(t.stored_counts(spark, d), t.stored_calendar(spark, d), t.SHIP)


@query
def sensor_days(spark, d):
    return day_rows(spark, d)


@query
def period_counts(spark, d):
    return sd.period_counts(day_rows(spark, d))


@query
def classify_sensors(spark, d):
    return rounded(sd.classify_sensors(day_rows(spark, d), t.SHIP))


def window_observations(spark, d):
    everyone = F.lit(True)
    return recovery.observations(
        day_rows(spark, d), {w: (w, everyone) for w in ("daily", "am_peak", "evening")}
    )


@query
def normal_equations(spark, d):
    weekly = written(recovery.weekly_cells(window_observations(spark, d)), "cells")
    equations = recovery.normal_equations(weekly, recovery.sensor_sums(weekly, t.SHIP), t.SHIP)
    return rounded(equations.where(F.abs("x") > 1e-7))


@query
def recovery_sizes(spark, d):
    sizes = recovery.fit_sizes(recovery.weekly_cells(window_observations(spark, d)))
    return sizes.select("fit", F.col("rows").cast("bigint"), "sensors", "weeks", "columns")


@query
def weekday_recovery_saturated(spark, d):
    return rounded(recovery.saturated_recovery(day_rows(spark, d), "daily", t.SHIP))


def sensor_day_table(spark, d):
    return analysis.study_days(
        t.stored_counts(spark, d), t.stored_calendar(spark, d), t.sensors(spark, d), t.SHIP
    )


def study_days(spark, d):
    return t.stored(spark, d, sensor_day_table)


@query
def weekday_recovery(spark, d):
    return rounded(analysis.weekday_recovery(study_days(spark, d), t.SHIP))


@query
def weekday_recovery_by_type(spark, d):
    return rounded(analysis.weekday_recovery_by_type(study_days(spark, d), t.SHIP))


@query
def recovery_by_window(spark, d):
    return rounded(analysis.recovery_by_window(study_days(spark, d), t.SHIP))


@query
def gap_by_window(spark, d):
    return rounded(analysis.gap_by_window(study_days(spark, d), t.SHIP))


@query
def robustness(spark, d):
    return rounded(analysis.robustness(study_days(spark, d), t.SHIP))


@query
def per_sensor_gap(spark, d):
    return rounded(analysis.per_sensor_gap(study_days(spark, d), t.SHIP))


@query
def gap_share(spark, d):
    return analysis.gap_share(analysis.per_sensor_gap(study_days(spark, d), t.SHIP))


# --- model -----------------------------------------------------------------------

# backtest, backtest_folds and day_ahead check what does not depend on the trees' values: that every row of
# the whole job got a forecast; the forecasts themselves follow further down


def twelve_months(spark, d):
    """The last twelve months of the counts, as far as a month of training precedes them."""
    first, last = span(spark, d)
    month = last.year * 12 + last.month - 12
    begun = first.year * 12 + first.month
    month = max(month, begun)
    return date(month // 12, month % 12 + 1, 1), last


@query
def backtest(spark, d):
    """The hours of twelve months with their baseline, the rows their fold learned from, and whether they have a forecast."""
    results = t.stored(spark, d, whole_backtest_rows)
    fine = F.col("model").isNotNull() & (F.col("model") >= 0)
    return rounded(
        results.select(
            "sensor_id", "date", "hour", F.col("count").cast("double"), "baseline", "train_rows",
            fine.alias("has_forecast"),
        )
    )


@query
def backtest_folds(spark, d):
    results = t.stored(spark, d, whole_backtest_rows)
    return rounded(
        results.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
            F.count("*").alias("rows"),
            F.max("train_rows").alias("train_rows"),
            F.sum("count").alias("people"),
            F.sum("baseline").alias("baseline"),
            F.count_if(F.col("model").isNull() | (F.col("model") < 0)).alias("bad_predictions"),
        )
    )


def coming_features(spark, d):
    """The features of the two weeks behind the newest count, under typical weather."""
    days = cal.day_spine(spark, *coming_days(spark, d))
    return (
        t.stored_counts(spark, d),
        t.stored_calendar(spark, d),
        weather.typical_weather(t.stored_weather(spark, d), days),
        t.sensors(spark, d).withColumnRenamed("location_id", "sensor_id"),
        *coming_days(spark, d),
    )


@query
def day_ahead(spark, d):
    """The coming days with their typical day, and whether the model of all counts forecasts them."""
    _, daily = forecast.forecast_days(one_model(spark, d), *coming_features(spark, d), t.stored_faults(spark, d))
    fine = F.col("forecast").isNotNull() & (F.col("forecast") >= 0)
    return rounded(daily.withColumn("has_forecast", fine).drop("forecast", "change"))


def whole_backtest_rows(spark, d):
    return forecast.backtest(
        t.stored_counts(spark, d),
        t.stored_calendar(spark, d),
        t.stored_weather(spark, d),
        *twelve_months(spark, d),
        span(spark, d)[0],
        t.SHIP,
        settings=TreeSettings(),
    )


def whole_model(spark, d):
    """The model of all counts."""
    return forecast.train_model(
        t.stored_counts(spark, d),
        t.stored_calendar(spark, d),
        t.stored_weather(spark, d),
        *span(spark, d),
        t.SHIP,
        settings=TreeSettings(),
    )


_models: dict[tuple[str, str], model.HourlyModel] = {}


def one_model(spark, d):
    """The model of all counts of this application, trained on first use."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _models or _models[key].levels.sparkSession is not spark:
        _models[key] = whole_model(spark, d)
    return _models[key]


def whole_ratio_model(spark, d):
    """The model of all counts as shares of their baselines."""
    return forecast.train_model(
        t.stored_counts(spark, d),
        t.stored_calendar(spark, d),
        t.stored_weather(spark, d),
        *span(spark, d),
        t.SHIP,
        target="ratio",
        settings=TreeSettings(),
    )


@query
def backtest_forecasts(spark, d):
    """The model's forecast beside the count, for every hour of twelve months."""
    results = t.stored(spark, d, whole_backtest_rows)
    return rounded(
        results.select("sensor_id", "date", "hour", F.col("count").cast("double"), "baseline", "model", "train_rows")
    )


@query
def backtest_forecast_folds(spark, d):
    results = t.stored(spark, d, whole_backtest_rows)
    return rounded(
        results.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
            F.count("*").alias("rows"),
            F.max("train_rows").alias("train_rows"),
            F.sum("count").alias("people"),
            F.sum("baseline").alias("baseline"),
            F.sum("model").alias("model"),
        )
    )


@query
def feature_importance(spark, d):
    return model.feature_importance(one_model(spark, d))


@query
def day_ahead_forecasts(spark, d):
    """Forecast and change against the typical day, for the two weeks behind the newest count."""
    _, daily = forecast.forecast_days(one_model(spark, d), *coming_features(spark, d), t.stored_faults(spark, d))
    return rounded(daily)


@query
def day_ahead_ratio_forecasts(spark, d):
    """The same by a model of the count as a share of its baseline."""
    _, daily = forecast.forecast_days(whole_ratio_model(spark, d), *coming_features(spark, d), t.stored_faults(spark, d))
    return rounded(daily)
