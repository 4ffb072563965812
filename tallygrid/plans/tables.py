"""The study's tables derived from the generic benchmark tables.

Shipments stand in for counts (suppliers grouped to sites, ship date, line
number as the hour), orders for weather and the calendar, suppliers for the
sensor list, web events for true hourly counts. Every frame reads its whole
table, and the number of sites grows with it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.joins import broadcast_up_to
from ..operators.calendar import build_calendar, days_spanned
from ..operators.coverage import fault_days
from ..operators.weather import MEASURES, local_hours, weather_view
from ..params import Params
from ..session import written

SUPPLIERS_PER_SITE = 20
USERS_PER_SITE = 50
EVENT_NAMES = ("urgent", "high", "medium", "not_specified", "low")
SOURCE_SPLIT = date(1999, 1, 1)

SHIP = Params(
    sensors=None,
    moved_sensors=(3,),
    base_year=1996,
    base_hours=366 * 4,
    recent_start=date(1999, 1, 1),
    recent_end=date(2000, 12, 31),
    recent_hours=731 * 4,
    min_coverage=0.5,
    slots_per_day=4,
    hours=(0, 6, 12, 18),
    fault_min_rows=2,
    season_years=(1996, 1998),
    event_names=EVENT_NAMES,
    windows={
        "daily": (0, 23),
        "am_peak": (6, 6),
        "lunch": (12, 12),
        "pm_peak": (18, 18),
        "evening": (0, 0),
    },
    office_ratio=1.0,
)

def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def site(key: str, size: int) -> Column:
    return F.floor(F.col(key) / size).cast("int")


def ship_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts with four slots a day (hours 0, 6, 12, 18), in two sources.

    Zeros are put in on every 37th day of the year at every fifth site, as the
    data has no dead sensors of its own.
    """
    lines = read(spark, folder, "lineitem").select(
        site("l_suppkey", SUPPLIERS_PER_SITE).alias("sensor_id"),
        F.to_date("l_shipdate").alias("date"),
        ((F.col("l_linenumber") % 4) * 6).cast("tinyint").alias("hour"),
        "l_quantity",
    )
    dead = (F.dayofyear("date") % 37 == 0) & (F.col("sensor_id") % 5 == 0)
    return (
        lines.groupBy("sensor_id", "date", "hour")
        .agg(F.sum("l_quantity").cast("int").alias("total"))
        .select(
            "sensor_id",
            "date",
            "hour",
            F.when(dead, 0).otherwise(F.col("total")).alias("count"),
            F.when(F.col("date") < F.lit(SOURCE_SPLIT), fixed.ARCHIVE_SOURCE)
            .otherwise(fixed.LIVE_SOURCE)
            .alias("source"),
        )
    )


def raw_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unaggregated shipments as text rows of the portal layout.

    Supplier, day and line number repeat, with equal and with differing
    quantities; returned lines with a discount carry unreadable text.
    """
    lines = read(spark, folder, "lineitem")
    quantity = F.when(
        (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1), F.lit("n/a")
    ).otherwise(F.col("l_quantity").cast("string"))
    return lines.select(
        F.col("l_suppkey").cast("string").alias("location_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("sensing_date"),
        F.col("l_linenumber").cast("string").alias("hourday"),
        quantity.alias("pedestriancount"),
    )


def archive_text(spark: SparkSession, folder: str) -> DataFrame:
    """The same shipments in the archive layout, with its long date text."""
    lines = read(spark, folder, "lineitem")
    moment = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("l_linenumber") * 3
    )
    return lines.select(
        F.col("l_suppkey").cast("string").alias("sensor_id"),
        F.date_format(moment, "MMMM dd, yyyy hh:mm:ss a").alias("date_time"),
        F.col("l_quantity").cast("string").alias("hourly_counts"),
    )


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Web events per group of users and UTC hour."""
    return (
        read(spark, folder, "events")
        .groupBy(
            site("user_id", USERS_PER_SITE).alias("sensor_id"),
            F.to_date("ts").alias("date"),
            F.hour("ts").cast("tinyint").alias("hour"),
        )
        .agg(F.count("*").cast("int").alias("count"))
    )


def _measures(total: Column, peak: Column, rows: Column) -> dict[str, Column]:
    # quarter units: sums stay exact, so averages do not depend on row order
    def quarters(value: Column) -> Column:
        return value.cast("double") / 4

    return {
        "temperature_2m": quarters(total % 240 - 32),
        "apparent_temperature": quarters(total % 220 - 28),
        "precipitation": quarters(F.greatest(peak % 40 - 20, F.lit(0))),
        "rain": quarters(F.greatest(peak % 40 - 24, F.lit(0))),
        "relative_humidity_2m": quarters(peak % 400),
        "cloud_cover": quarters(total % 400),
        "wind_speed_10m": quarters(rows % 160),
    }


def web_weather(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly weather from the events' values, stamped in UTC with local hour."""
    value = F.round("value").cast("bigint")
    hourly = (
        read(spark, folder, "events")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_utc"))
        .agg(F.sum(value).alias("total"), F.max(value).alias("peak"), F.count("*").alias("rows"))
    )
    measures = _measures(F.col("total"), F.col("peak"), F.col("rows"))
    return local_hours(hourly.select("ts_utc", *[c.alias(n) for n, c in measures.items()]))


def ship_weather(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly weather from the orders' prices over years of local time changes."""
    price = F.round("o_totalprice").cast("bigint")
    stamp = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(
        hours=(F.col("o_orderkey") % 24).cast("int")
    )
    hourly = (
        read(spark, folder, "orders")
        .groupBy(stamp.alias("ts_utc"))
        .agg(F.sum(price).alias("total"), F.max(price).alias("peak"), F.count("*").alias("rows"))
    )
    measures = _measures(F.col("total"), F.col("peak"), F.col("rows"))
    return local_hours(hourly.select("ts_utc", *[c.alias(n) for n, c in measures.items()]))


def weather_payload(spark: SparkSession, folder: str) -> DataFrame:
    """The orders' weather as responses of parallel arrays, one per month.

    A response holds the hours of one month, 744 at most.
    """
    rows = ship_weather(spark, folder).withColumn(
        "time", F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm")
    )
    hours = F.array_sort(F.collect_list(F.struct("time", *MEASURES)))
    packed = rows.groupBy(F.trunc("ts_utc", "MM").alias("month")).agg(hours.alias("hours"))
    return packed.select(
        F.struct(*[F.col(f"hours.{c}").alias(c) for c in ("time", *MEASURES)]).alias("hourly")
    )


def ship_weather_view(spark: SparkSession, folder: str) -> DataFrame:
    return weather_view(ship_weather(spark, folder))


def sensors(spark: SparkSession, folder: str) -> DataFrame:
    """One sensor per site of suppliers, placed by account balance."""
    nation = F.min("s_nationkey")
    return (
        read(spark, folder, "supplier")
        .groupBy(site("s_suppkey", SUPPLIERS_PER_SITE).alias("location_id"))
        .agg(
            F.min("s_name").alias("sensor_description"),
            (F.lit(-37.8190) + F.round(F.max("s_acctbal")) / 1_200_000).alias("latitude"),
            (F.lit(144.9530) + F.round(F.min("s_acctbal")) / 1_200_000).alias("longitude"),
            F.when(nation == 0, F.lit("Pushbox Upgrade")).alias("note"),
        )
    )


def holidays(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates that fall on five fixed holidays."""
    days = read(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    day = F.date_format("date", "MM-dd")
    name = (
        F.when(day == "01-01", "New Year's Day")
        .when(day == "01-26", "Australia Day")
        .when(day == "04-25", "Anzac Day")
        .when(day == "12-25", "Christmas Day")
        .when(day == "12-26", "Boxing Day")
    )
    return days.select("date", name.alias("holiday_name")).where("holiday_name is not null")


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """A term in each quarter of 1996-2000, between its first and last orders."""
    day = F.to_date("o_orderdate")
    return (
        read(spark, folder, "orders")
        .where(day.between(F.lit(date(1996, 1, 1)), F.lit(date(2000, 12, 31))))
        .groupBy(F.year(day).alias("year"), F.quarter(day).alias("term"))
        .agg(
            F.date_add(F.min(day), 20).alias("start"),
            F.date_sub(F.max(day), 10).alias("end"),
        )
        .where("start <= end")
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Three days from the newest order of each priority and year."""
    orders = read(spark, folder, "orders")
    name = F.replace(F.lower(F.substr("o_orderpriority", F.lit(3))), F.lit(" "), F.lit("_"))
    day = F.to_date("o_orderdate")
    return (
        orders.groupBy(name.alias("event"), F.year(day).alias("year"))
        .agg(F.max_by(day, "o_orderkey").alias("start"))
        .select("event", "start", F.date_add("start", 2).alias("end"))
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Every day from the first shipment to 90 days after the last."""
    ship_days = read(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return build_calendar(
        days_spanned(ship_days, ahead=fixed.CALENDAR_DAYS_AHEAD),
        holidays(spark, folder),
        terms(spark, folder),
        events(spark, folder),
        EVENT_NAMES,
    )


def odd_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """A calendar of shipments with what the other one lacks.

    Its events are named by the data alone, one of them ends before it starts,
    and every 26 January has two holidays.
    """
    lines = read(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_returnflag")
    length = F.when(F.col("l_returnflag") == "R", -1).otherwise(2)
    happenings = (
        lines.groupBy(
            F.concat(F.lit("Flag "), F.lower("l_returnflag")).alias("event"),
            F.year("date").alias("year"),
            length.alias("length"),
        )
        .agg(F.min("date").alias("start"))
        .select("event", "start", F.expr("date_add(start, length)").alias("end"))
    )
    twice = lines.select("date").distinct().where("date_format(date, 'MM-dd') = '01-26'")
    names = F.explode(F.array(F.lit("Survival Day"), F.lit("Australia Day")))
    return build_calendar(
        days_spanned(lines),
        twice.select("date", names.alias("holiday_name")),
        terms(spark, folder),
        happenings,
    )


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(
    spark: SparkSession,
    folder: str,
    make: Callable[[SparkSession, str], DataFrame],
    by_month: bool = False,
) -> DataFrame:
    """A derived table, written to the shared folder at its first use.

    As in production, queries read stored tables rather than raw files: one
    build per application and folder, then any number of queries.
    """
    key = (spark.sparkContext.applicationId, folder, make.__name__)
    if key not in _stored or _stored[key].sparkSession is not spark:
        rows, parts = make(spark, folder), ()
        if by_month:
            month = F.trunc("date", "MM").alias("month")
            rows, parts = rows.select("*", month).hint("rebalance", F.col("month")), ("month",)
        _stored[key] = written(rows, make.__name__, parts)
    return _stored[key]


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``ship_counts`` with its ``month`` partition column."""
    return stored(spark, folder, ship_counts, by_month=True)


def ship_faults(spark: SparkSession, folder: str) -> DataFrame:
    return fault_days(stored_counts(spark, folder), SHIP)


def stored_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Fault days of the stored counts, as a load keeps them (``sources.day_parts``)."""
    faults = stored(spark, folder, ship_faults)
    return broadcast_up_to(faults, faults.count())


def stored_weather(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly weather view over stored weather."""
    return weather_view(stored(spark, folder, ship_weather))


def stored_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, calendar)
