"""Tables kept between runs, as plain Parquet folders plus a log of loads.

A load never rewrites what is there. Counts of a load go to their own folder;
one row in the log then makes them visible. Which rows of earlier loads they
replace is decided when reading: a row counts until a later load of its source
starts on or before its date. Adding two weeks of live data therefore writes
two weeks, however large the table, and a run that dies half-way leaves only an
unlisted folder behind, which the next run overwrites. One run writes at a time.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..fixed import ARCHIVE_SOURCE, LIVE_SOURCE
from . import schemas

LOG_SCHEMA = "table string, source string, load int, first_date date, rows bigint"
LOAD_ON_DISK = "sensor_id int, date date, hour tinyint, count int, month date"
COUNTS_ON_DISK = f"{LOAD_ON_DISK}, source string, load int"


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All loads so far, a few rows per run."""
    return read_or_empty(spark, f"{root}/loads", LOG_SCHEMA)


def append_counts(spark: SparkSession, root: str, clean: DataFrame, source: str) -> int:
    """Add one clean batch of a source, replacing that source from its first day on.

    Returns the rows kept; an empty batch changes nothing.
    """
    load = _next_load(spark, root, "counts")
    path = f"{root}/counts/source={source}/load={load}"
    # rebalancing gathers a month's rows and splits months too large for one task;
    # sorted rows let a scan for some sensors skip row groups
    (
        clean.select("sensor_id", "date", "hour", "count", F.trunc("date", "MM").alias("month"))
        .hint("rebalance", F.col("month"))
        .sortWithinPartitions("month", "sensor_id", "date", "hour")
        .write.mode("overwrite")
        .partitionBy("month")
        .parquet(path)
    )
    stored = read_or_empty(spark, path, LOAD_ON_DISK)
    rows, first = stored.agg(F.count("*"), F.min("date")).first()
    if rows:
        log_load(spark, root, "counts", source, load, first, rows)
    return rows


def read_counts(spark: SparkSession, root: str, reconcile: bool = True) -> DataFrame:
    """The visible counts: newest load wins, live wins over the archive.

    Carries the ``month`` partition column, so date ranges skip whole months.
    """
    stored = read_or_empty(spark, f"{root}/counts", COUNTS_ON_DISK)
    visible = visible_loads(read_log(spark, root), reconcile)
    return (
        stored.join(visible, ["source", "load"])
        .where(F.col("visible_until").isNull() | (F.col("date") < F.col("visible_until")))
        .select("sensor_id", "date", "hour", "count", "source", "month")
    )


def visible_loads(log: DataFrame, reconcile: bool = True) -> DataFrame:
    """Per load of counts, the date from which a later load replaces it (or NULL)."""
    later = Window.partitionBy("source").orderBy("load").rowsBetween(1, Window.unboundedFollowing)
    loads = log.where(F.col("table") == "counts").withColumn(
        "visible_until", F.min("first_date").over(later)
    )
    if reconcile:
        # the log is a few rows per run, so its windows may be single tasks
        live_first = F.when(F.col("source") == LIVE_SOURCE, F.col("first_date"))
        loads = loads.withColumn("live_start", F.min(live_first).over(Window.partitionBy()))
        loads = loads.withColumn(
            "visible_until",
            F.when(
                F.col("source") == ARCHIVE_SOURCE, F.least("visible_until", "live_start")
            ).otherwise(F.col("visible_until")),
        )
    # a load replaced from its first day on has nothing left to read
    kept = F.col("visible_until").isNull() | (F.col("first_date") < F.col("visible_until"))
    return loads.where(kept).select("source", "load", "visible_until")


def compact_counts(spark: SparkSession, root: str, source: str) -> int:
    """Write a source's visible rows as one new load, which hides all earlier ones."""
    rows = read_counts(spark, root).where(F.col("source") == source)
    return append_counts(spark, root, rows.drop("source", "month"), source)


def replace_table(spark: SparkSession, root: str, name: str, rows: DataFrame) -> int:
    """Store a small table (sensors, weather, calendar) as a new version.

    The version being read stays untouched until the log names the new one.
    """
    load = _next_load(spark, root, name)
    path = f"{root}/{name}/version={load}"
    rows.write.mode("overwrite").parquet(path)
    count = spark.read.parquet(path).count()
    log_load(spark, root, name, None, load, None, count)
    return count


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    return not read_log(spark, root).where(F.col("table") == name).isEmpty()


def read_table(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """The newest version; an absent table reads as empty if ``schema`` is given."""
    newest = (
        read_log(spark, root).where(F.col("table") == name).agg(F.max("load")).first()[0]
    )
    if newest is None:
        if schema is None:
            raise LookupError(f"table {name} has not been loaded yet")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/{name}/version={newest}")


def read_weather_hourly(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "weather_hourly", schemas.WEATHER_HOURLY)


def _next_load(spark: SparkSession, root: str, table: str) -> int:
    last = read_log(spark, root).where(F.col("table") == table).agg(F.max("load")).first()[0]
    return (last or 0) + 1


def log_load(
    spark: SparkSession, root: str, table: str, source, load: int, first: date | None, rows: int
) -> None:
    entry = spark.createDataFrame([(table, source, load, first, rows)], LOG_SCHEMA)
    entry.coalesce(1).write.mode("append").parquet(f"{root}/loads")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
