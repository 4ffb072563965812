"""The registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, ordered

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")

SAMPLE = [
    "clean_counts",
    "conflict_report",
    "replace_window",
    "reconcile_sources",
    "weather_local",
    "calendar",
    "completeness_grid",
    "fault_days",
    "smoothed_series",
    "relative_to_median",
    "seasonal_baseline",
    "feature_dataset",
    "worst_baseline_days",
    "sensor_days",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    ours = ordered(entry_module.queries()[name](spark, FOLDER).toPandas())
    theirs = ordered(duck.execute(entry_module.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


def test_every_oracle_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_returns_rows(spark):
    assert entry_module.entry(spark).count() > 0
