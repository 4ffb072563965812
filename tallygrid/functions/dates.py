"""Date expressions: weekday numbering, ISO weeks, periods, day types."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import DAY_TYPES
from ..params import Params


def weekday(day: Column | str) -> Column:
    """Weekday number with 0 = Sunday ... 6 = Saturday (Spark itself starts at 1)."""
    return F.dayofweek(day) - 1


def weekday_name(day: Column | str) -> Column:
    """'Mon' ... 'Sun'."""
    return F.date_format(day, "EEE")


def iso_week(day: Column | str) -> Column:
    """ISO year and week such as '2020-53'."""
    day = F.col(day) if isinstance(day, str) else day
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat(year, F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_end(day: Column | str) -> Column:
    """The Sunday that closes the week of ``day``."""
    day = F.col(day) if isinstance(day, str) else day
    return F.date_add(day, F.pmod(F.lit(1) - F.dayofweek(day), F.lit(7)))


def month_start(day: Column | str) -> Column:
    return F.trunc(day, "MM")


def days_in_month(day: Column | str) -> Column:
    return F.dayofmonth(F.last_day(day))


def day_type(day: Column | str) -> Column:
    monday, midweek, friday, weekend = DAY_TYPES
    number = weekday(day)
    return (
        F.when(number == 1, monday)
        .when(number == 5, friday)
        .when(number.isin(0, 6), weekend)
        .otherwise(midweek)
    )


def between_days(df: DataFrame, start: date, end: date, day: str = "date") -> DataFrame:
    """Rows of an inclusive date range.

    Where the frame carries the ``month`` partition column, the same range is
    put on it, so that whole months are skipped at the scan.
    """
    kept = df.where(F.col(day).between(F.lit(start), F.lit(end)))
    if day == "date" and "month" in df.columns and dict(df.dtypes)["month"] == "date":
        kept = kept.where(
            F.col("month").between(F.lit(start.replace(day=1)), F.lit(end.replace(day=1)))
        )
    return kept


def in_base(params: Params, day: str = "date") -> Column:
    return F.col(day).between(F.lit(params.base_start), F.lit(params.base_end))


def in_recent(params: Params, day: str = "date") -> Column:
    return F.col(day).between(F.lit(params.recent_start), F.lit(params.recent_end))


def period(params: Params, day: str = "date") -> Column:
    """The base year's label or 'recent'; rows outside both are filtered before."""
    return F.when(in_base(params, day), params.base_label).otherwise("recent")


def in_scope(df: DataFrame, params: Params) -> DataFrame:
    """Rows of the base year or the recent period, for the chosen sensors."""
    first = min(params.base_start, params.recent_start)
    last = max(params.base_end, params.recent_end)
    kept = between_days(of_sensors(df, params), first, last)
    return kept.where(in_base(params) | in_recent(params))


def of_sensors(df: DataFrame, params: Params, sensor: str = "sensor_id") -> DataFrame:
    """Rows of the chosen sensors; the list reaches the Parquet scan."""
    if params.sensors is None:
        return df
    return df.where(F.col(sensor).isin(*params.sensors))
