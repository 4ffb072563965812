"""One row per day: holidays, school terms, events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import normal_name


def day_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every day from ``start`` to ``end``, both included; none if the end comes first."""
    last = max(start, end)
    return spark.range(int(start <= end)).select(
        F.explode(F.sequence(F.lit(start), F.lit(last), F.expr("interval 1 day"))).alias("date")
    )


def days_spanned(rows: DataFrame, day: str = "date", ahead: int = 0) -> DataFrame:
    """Every day from the first date of ``rows`` to ``ahead`` days after the last."""
    last = F.date_add(F.max(day), ahead)
    return rows.agg(F.min(day).alias("first"), last.alias("last")).select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date")
    )


def days_inside(intervals: DataFrame, *keep: str) -> DataFrame:
    """The distinct days covered by [start, end] intervals.

    Turns "day between start and end" into an equi join on the day. An interval
    that ends before it starts covers no day.
    """
    return intervals.where("start <= end").select(
        *keep,
        F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("date"),
    ).distinct()


def build_calendar(
    days: DataFrame,
    holidays: DataFrame,
    terms: DataFrame,
    events: DataFrame,
    event_names: Sequence[str] = (),
) -> DataFrame:
    """Days with holiday name and flag, school term, one flag per event.

    ``school_term`` is NULL for years the term table does not list: unknown,
    not "on holidays". Several holidays of a day are named in order, joined by
    "; ". The flag columns are those of ``event_names`` and then of any other
    event in the table, which one look at its few names decides. Spellings that
    give the same column are one event.
    """
    found = [r.event for r in events.select("event").distinct().orderBy("event").collect() if r.event]
    spellings: dict[str, list[str]] = {}
    for spelling in dict.fromkeys([*event_names, *found]):
        spellings.setdefault(event_column(spelling), []).append(spelling)
    year = F.array(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))
    listed = terms.select("year").distinct().select(
        F.explode(F.sequence(year[0], year[1], F.expr("interval 1 day"))).alias("date")
    )
    facts = {
        "is_day": days.select("date"),
        "in_term": days_inside(terms).select("date"),
        "listed": listed,
    }
    # every source says something about days: one union, one grouping, no joins
    rows = holidays.select("date", "holiday_name").unionByName(
        days_inside(events, "event").select("date", "event"), allowMissingColumns=True
    )
    for flag, marked in facts.items():
        rows = rows.unionByName(marked.withColumn(flag, F.lit(True)), allowMissingColumns=True)
    by_day = rows.groupBy("date").agg(
        F.array_join(F.array_sort(F.collect_set("holiday_name")), "; ").alias("holiday_name"),
        *[F.bool_or(flag).alias(flag) for flag in facts],
        *[
            F.coalesce(F.bool_or(F.col("event").isin(names)), F.lit(False)).alias(column)
            for column, names in spellings.items()
        ],
    )
    name = F.when(F.col("holiday_name") != "", F.col("holiday_name"))
    return by_day.where("is_day").select(
        "date",
        name.alias("holiday_name"),
        name.isNotNull().alias("is_holiday"),
        F.when(F.col("listed"), F.coalesce("in_term", F.lit(False))).alias("school_term"),
        *spellings,
    )


def event_column(name: str) -> str:
    return f"event_{normal_name(name)}"


def with_holiday_neighbours(calendar: DataFrame) -> DataFrame:
    """Add whether the next and the previous calendar row are holidays.

    The window has no partition because the calendar is one short series: a
    row per day, a few thousand for decades.
    """
    by_day = Window.orderBy("date")
    return calendar.withColumns(
        {
            "day_before_holiday": F.lead("is_holiday", 1, False).over(by_day),
            "day_after_holiday": F.lag("is_holiday", 1, False).over(by_day),
        }
    )


def holiday_on(calendar: DataFrame, day: date) -> DataFrame:
    """The holiday's name on one day, or NULL."""
    return calendar.where(F.col("date") == F.lit(day)).select("date", "holiday_name")
