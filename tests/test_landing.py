"""Updates that open only the landed files they need, against updates that open all."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallygrid.plans import update as run
from tallygrid.sources import landing, store
from tallygrid.sources.count_files import read_count_files

HEADER = "location_id,sensing_date,hourday,pedestriancount\n"


def put(folder, name, first, days, count, extra=""):
    lines = (
        f"{s},{first + timedelta(n)},{h},{count + s}\n"
        for s in (3, 4) for n in range(days) for h in (7, 19)
    )
    (folder / name).write_text(HEADER + "".join(lines) + extra)


@pytest.fixture
def opened(monkeypatch):
    """The names of the files each load opened."""
    calls = []

    def spy(spark, paths, with_file=False):
        paths = [paths] if isinstance(paths, str) else list(paths)
        calls.append([os.path.basename(p) for p in paths])
        return read_count_files(spark, paths, with_file)

    monkeypatch.setattr(run, "read_count_files", spy)
    return calls


@pytest.fixture
def zone(tmp_path):
    folder = tmp_path / "live files"
    folder.mkdir()
    put(folder, "march 1.csv", date(2034, 3, 1), 20, 100)
    put(folder, "march2.csv", date(2034, 3, 21), 11, 200)
    put(folder, "april.csv", date(2034, 4, 1), 20, 300)
    return folder


def visible(spark, root):
    return sorted(tuple(r) for r in store.read_counts(spark, root).drop("month").collect())


def load(spark, root, zone, since):
    return run.load_live(spark, root, str(zone), since)


def test_unchanged_files_are_not_opened(spark, tmp_path, zone, opened):
    root = str(tmp_path / "lake")
    assert load(spark, root, zone, None) == 51 * 4
    before = visible(spark, root)
    assert load(spark, root, zone, date(2034, 4, 6)) == 0
    assert len(opened) == 1 and visible(spark, root) == before
    # loading the same files whole once more brings nothing either
    assert load(spark, root, zone, None) == 0 and len(opened) == 1


def test_files_before_the_window_stay_closed(spark, tmp_path, zone, opened):
    root, plain = str(tmp_path / "lake"), str(tmp_path / "plain")
    since = date(2034, 4, 6)
    load(spark, root, zone, None)
    run.load_counts(spark, plain, read_count_files(spark, str(zone)), "live")
    put(zone, "may.csv", date(2034, 4, 21), 5, 400)
    load(spark, root, zone, since)
    assert opened[1] == ["april.csv", "may.csv"]
    # a changed old file is opened, and gives nothing before the window
    put(zone, "march 1.csv", date(2034, 3, 1), 20, 1100)
    load(spark, root, zone, since)
    assert opened[2] == ["april.csv", "march 1.csv", "may.csv"]
    whole = read_count_files(spark, str(zone)).where(F.col("date") >= F.lit(since))
    run.load_counts(spark, plain, whole, "live")
    assert visible(spark, root) == visible(spark, plain)
    # its end is known to be before the window now
    put(zone, "june.csv", date(2034, 4, 26), 2, 500)
    load(spark, root, zone, since)
    assert opened[3] == ["april.csv", "june.csv", "may.csv"]


def test_a_file_that_goes_takes_its_days_along(spark, tmp_path, zone, opened):
    root = str(tmp_path / "lake")
    put(zone, "may.csv", date(2034, 4, 21), 5, 400)
    load(spark, root, zone, None)
    os.replace(zone / "may.csv", tmp_path / "may.txt")
    load(spark, root, zone, date(2034, 4, 11))
    assert opened[1] == ["april.csv"]
    assert max(r[1] for r in visible(spark, root)) == date(2034, 4, 20)
    assert load(spark, root, zone, date(2034, 4, 11)) == 0 and len(opened) == 2


def test_a_window_that_starts_earlier_is_loaded(spark, tmp_path, zone, opened):
    root = str(tmp_path / "lake")
    load(spark, root, zone, date(2034, 4, 6))
    assert min(r[1] for r in visible(spark, root)) == date(2034, 4, 6)
    load(spark, root, zone, date(2034, 3, 25))
    # files of the first load end at the latest on the day before its window
    assert opened[1] == ["april.csv", "march 1.csv", "march2.csv"]
    assert min(r[1] for r in visible(spark, root)) == date(2034, 3, 25)


def test_unreadable_dates_keep_a_file_open_for_the_gate(spark, tmp_path, zone, opened):
    root = str(tmp_path / "lake")
    put(zone, "march 1.csv", date(2034, 3, 1), 20, 100, "3,soon,7,1\n")
    load(spark, root, zone, None)
    put(zone, "may.csv", date(2034, 4, 21), 20, 400)
    load(spark, root, zone, date(2034, 4, 1))
    assert opened[1] == ["april.csv", "march 1.csv", "may.csv"]


def test_a_failed_load_is_tried_again(spark, tmp_path, zone, opened):
    root = str(tmp_path / "lake")
    (zone / "bad.csv").write_text(HEADER + "x,2034-05-01,y,z\n" * 300)
    for attempt in (1, 2):
        with pytest.raises(ValueError, match="failed to parse"):
            load(spark, root, zone, None)
        assert len(opened) == attempt
    assert landing._noted(spark, root, "live").isEmpty()


def test_an_empty_folder_is_an_error_as_before(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(RuntimeError, match="No CSV files"):
        load(spark, str(tmp_path / "lake"), tmp_path / "none", None)
