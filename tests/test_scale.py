"""Hot sensors, bounded broadcasts and join shapes."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tallygrid.functions import joins
from tallygrid.operators import clean, coverage, features, profiles
from tallygrid.params import Params
from tallygrid.session import shared_dir, written

ALL = Params(sensors=None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_collapses_before_the_shuffle(spark):
    """A third of all rows repeats one key: the repeats never travel."""
    rows = spark.range(300_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 1000).cast("int").alias("sensor_id"),
        F.lit(date(2024, 1, 1)).alias("date"),
        F.lit(5).cast("tinyint").alias("hour"),
        F.lit(7).alias("count"),
    )
    kept = clean.one_per_key(rows)
    assert kept.count() == rows.select("sensor_id").distinct().count()
    plan = plan_of(kept)
    assert plan.index("partial_min") > plan.index("Exchange")  # partial step below the shuffle


def test_hot_sensor_keeps_all_its_rows(spark):
    start = date(2023, 1, 1)
    days = spark.range(400).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    hot = days.select(F.lit(1).alias("sensor_id"), "date", hours.alias("hour"))
    rare = days.where(F.dayofmonth("date") == 1).select(
        F.explode(F.sequence(F.lit(2), F.lit(40))).alias("sensor_id"), "date", F.lit(9).alias("hour")
    )
    counts = hot.unionByName(rare).select(
        "sensor_id", "date", F.col("hour").cast("tinyint").alias("hour"), F.dayofyear("date").alias("count")
    )
    got = features.seasonal_baseline(counts, start + timedelta(60), start + timedelta(399), ALL)
    assert got.where("sensor_id = 1").count() == 340 * 24
    assert got.where("sensor_id = 1 AND baseline_weeks = 4").count() == 340 * 24


@pytest.mark.parametrize("limit, hinted", [(10, True), (9, False)])
def test_broadcast_only_within_the_measured_limit(spark, limit, hinted):
    side = joins.measured(spark.range(10), "side", limit)
    plan = side._jdf.queryExecution().analyzed().toString()
    assert ("ResolvedHint" in plan) is hinted


def test_joins_give_the_same_beyond_the_limit(spark, make_counts, monkeypatch):
    day = date(2025, 5, 5)
    counts = make_counts([(1, day, h, 0) for h in range(8, 20)] + [(2, day, h, 5) for h in range(8, 20)])
    small = coverage.without_faults(counts, ALL)
    monkeypatch.setattr(coverage, "measured", lambda df, name: joins.measured(df, name, limit=0))
    large = coverage.without_faults(counts, ALL)
    assert sorted(small.collect()) == sorted(large.collect())
    assert small.select("sensor_id").distinct().count() == 1


def test_written_copy_prunes_columns_and_partitions(spark, make_counts):
    rows = make_counts([(s, date(2025, 1, 1), 5, s) for s in range(5)]).withColumn("part", F.col("sensor_id") % 2)
    copy = written(rows, "copy", ("part",))
    assert copy.schema.names == rows.schema.names and copy.count() == 5
    plan = plan_of(copy.where("part = 1").select("count"))
    assert "ReadSchema: struct<count:int>" in plan and "(part#" in plan


def test_shared_folder_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize(
    "name",
    ["clean_counts", "calendar", "seasonal_baseline", "feature_dataset", "relative_to_median", "sensor_days", "weekly_history"],
)
def test_no_pair_joins_and_no_row_functions(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, "/root/testdata/sf0.001"))
    for word in ("Cartesian", "NestedLoop", "BatchEvalPython"):
        assert word not in plan


def test_feature_table_shuffles_the_counts_once(spark):
    df = entry_module.queries()["feature_dataset"](spark, "/root/testdata/sf0.001")
    plan = plan_of(df)
    lag_window = plan.index("rangeframe") if "rangeframe" in plan else plan.index("RangeFrame")
    below = plan[lag_window:]
    facts = below[: below.index("month#")]
    assert facts.count("Exchange hashpartitioning(sensor_id") == 1


def test_median_groups_hold_a_row_per_week(spark, make_counts):
    counts = make_counts([(1, date(2019, 1, 7) + timedelta(7 * w), 9, w + 1) for w in range(51)])
    hourly = counts.select("sensor_id", "date", "hour", "count").withColumns(
        {"temperature": F.lit(20.0), "precipitation_mm": F.lit(0.0)}
    )
    rows = profiles.relative_to_median(hourly, ALL)
    assert rows.count() == 51 and rows.groupBy("sensor_id", "dow", "hour").count().first()["count"] <= 53
