"""Partial results per load, so that reports need not read all counts again.

Next to the counts of a load stand

- ``days``: one row per sensor-day with its totals (``operators.sensor_days.day_totals``),
- ``faults``: the sensor-days that look like a dead sensor,
- ``months``: rows, date span and a bitmap of the sensors, per month and block of sensor ids.

Counts become visible or hidden by whole days, and any day of a source comes
from one load. Days and faults are therefore final: reading them filters and
never groups. A month that a later load replaces in part is summed anew from
its days; all other months are merged as they are.

Totals depend on the daytime hours, the fault rule and the windows, so each such
definition has a folder of its own. ``maintain`` builds what a visible load
lacks, also for loads written before, and logs a load when it is complete.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.joins import broadcast_up_to
from ..operators.coverage import faulty_days
from ..operators.sensor_days import day_totals
from ..params import Params
from . import store


def name_of(params: Params) -> str:
    """The folder and log name of the parts under this definition of a day."""
    definition = (params.daytime_hours, params.fault_min_rows, sorted(params.windows.items()))
    return f"parts-{hashlib.sha256(repr(definition).encode()).hexdigest()[:12]}"


def maintain(spark: SparkSession, root: str, params: Params) -> int:
    """Build the parts of every visible load that lacks them; returns how many were built."""
    missing = _missing(spark, root, params).collect()
    for load in missing:
        _build(spark, root, params, load.source, load.load)
    return len(missing)


def read_days(spark: SparkSession, root: str, params: Params) -> DataFrame:
    """Totals of every visible sensor-day, with its source and ``month`` partition."""
    return _visible(spark, root, params, "days").drop("load", "visible_until")


def read_faults(spark: SparkSession, root: str, params: Params) -> DataFrame:
    """Visible fault days; broadcast if the logged numbers of rows allow it."""
    faults = _visible(spark, root, params, "faults").select("sensor_id", "date")
    logged = store.read_log(spark, root).where(F.col("table") == name_of(params))
    return broadcast_up_to(faults, logged.agg(F.sum("rows")).first()[0] or 0)


def read_monthly(spark: SparkSession, root: str, params: Params) -> DataFrame:
    """Hours present per sensor and month."""
    days = read_days(spark, root, params)
    return days.groupBy("sensor_id", "month").agg(F.sum("_rows").alias("hours"))


def summary(spark: SparkSession, root: str, params: Params) -> DataFrame:
    """Rows, sensors and date span of each source, from the months' parts."""
    months = _parts(spark, root, params, "months").join(_loads(spark, root), ["source", "load"])
    until = F.col("visible_until")
    whole = months.where(until.isNull() | (F.col("last_date") < until))
    # the one month of a load in which a later one starts
    cut = months.where((F.col("first_date") < until) & (F.col("last_date") >= until))
    cut = cut.select("source", "load", "month").distinct()
    days = _visible(spark, root, params, "days")
    anew = month_parts(days.join(F.broadcast(cut), ["source", "load", "month"]), "source", "month")
    columns = ["source", "block", "rows", "sensors", "first_date", "last_date"]
    blocks = (
        whole.select(*columns)
        .unionByName(anew.select(*columns))
        .groupBy("source", "block")
        .agg(
            F.sum("rows").alias("rows"),
            F.bitmap_count(F.bitmap_or_agg("sensors")).alias("sensors"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
    )
    return blocks.groupBy("source").agg(
        F.sum("rows").alias("rows"),
        F.sum("sensors").alias("sensors"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def month_parts(days: DataFrame, *keys: str) -> DataFrame:
    """Mergeable sums of sensor-days; ``block`` numbers 32,768 consecutive sensor ids."""
    return days.groupBy(*keys, F.bitmap_bucket_number("sensor_id").alias("block")).agg(
        F.sum("_rows").alias("rows"),
        F.bitmap_construct_agg(F.bitmap_bit_position("sensor_id")).alias("sensors"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def _build(spark: SparkSession, root: str, params: Params, source: str, load: int) -> None:
    counts = spark.read.schema(store.LOAD_ON_DISK).parquet(
        f"{root}/counts/source={source}/load={load}"
    )
    at = f"source={source}/load={load}"
    base = f"{root}/{name_of(params)}"
    (
        day_totals(counts, params)
        .withColumn("month", F.trunc("date", "MM"))
        .hint("rebalance", F.col("month"))
        .sortWithinPartitions("month", "sensor_id", "date")
        .write.mode("overwrite")
        .partitionBy("month")
        .parquet(f"{base}/days/{at}")
    )
    days = spark.read.schema(_schema(params, "days")).parquet(f"{base}/days/{at}")
    faults = faulty_days(days, params)
    faults.write.mode("overwrite").parquet(f"{base}/faults/{at}")
    month_parts(days, "month").write.mode("overwrite").parquet(f"{base}/months/{at}")
    number = spark.read.schema(faults.schema).parquet(f"{base}/faults/{at}").count()
    store.log_load(spark, root, name_of(params), source, load, None, number)


def _schema(params: Params, part: str) -> str:
    if part == "faults":
        return "sensor_id int, date date"
    if part == "months":
        return "month date, block bigint, rows bigint, sensors binary, first_date date, last_date date"
    windows = "".join(f"`{name}` bigint, " for name in params.windows)
    return (
        f"sensor_id int, date date, {windows}"
        "_rows bigint, _daytime_rows bigint, _daytime_max int, month date"
    )


def _parts(spark: SparkSession, root: str, params: Params, part: str) -> DataFrame:
    """A part of all loads; a visible load without parts is an error, never a gap."""
    lacking = [f"{r.source} {r.load}" for r in _missing(spark, root, params).collect()]
    if lacking:
        raise LookupError(f"parts not built for loads {', '.join(lacking)}: call maintain first")
    schema = f"{_schema(params, part)}, source string, load int"
    return store.read_or_empty(spark, f"{root}/{name_of(params)}/{part}", schema)


def _visible(spark: SparkSession, root: str, params: Params, part: str) -> DataFrame:
    rows = _parts(spark, root, params, part).join(_loads(spark, root), ["source", "load"])
    return rows.where(_shown(F.col("date"), F.col("visible_until")))


def _shown(day: Column, until: Column) -> Column:
    return until.isNull() | (day < until)


def _loads(spark: SparkSession, root: str) -> DataFrame:
    # a few rows per run, as the log itself
    return F.broadcast(store.visible_loads(store.read_log(spark, root)))


def _missing(spark: SparkSession, root: str, params: Params) -> DataFrame:
    log = store.read_log(spark, root)
    built = log.where(F.col("table") == name_of(params)).select("source", "load")
    return store.visible_loads(log).join(built, ["source", "load"], "left_anti").orderBy("source", "load")
