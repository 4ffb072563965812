import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallygrid.session import session  # noqa: E402
from tallygrid.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def make_counts(spark):
    def make(rows, source="live"):
        rows = [(*row, source) if len(row) == 4 else row for row in rows]
        return spark.createDataFrame(rows, schemas.COUNTS)

    return make


@pytest.fixture
def level():
    """A made-up count for a day: distinct for a year, neither linear nor ordered."""
    return lambda day: (day.toordinal() * 37) % 1009 + 20


@pytest.fixture
def leveled(make_counts, level):
    """One sensor at two hours with ``level`` as its count, the later hour half of it."""

    def make(days, start=date(2033, 2, 7), sensor=71):
        rows = []
        for n in range(days):
            day = start + timedelta(n)
            rows += [(sensor, day, 6, level(day)), (sensor, day, 18, level(day) // 2)]
        return make_counts(rows), start

    return make
