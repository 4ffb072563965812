"""Reading, gating, cleaning and storing count files."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import clean, incremental
from tallygrid.plans.update import load_counts
from tallygrid.sources import store
from tallygrid.sources.count_files import read_as_text, read_count_files, typed_counts

ARCHIVE_HEAD = "Record,Sensor ID,Hourly_Counts,Date_Time,Street\n"
PORTAL_HEAD = "sensing_date,pedestriancount,location_id,hourday,note\n"


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(text)
    return str(path)


def load(spark, root, path, source):
    return load_counts(spark, root, read_count_files(spark, path), source)


def rows(df):
    return {(r.sensor_id, r.date, r.hour, r["count"]) for r in df.collect()}


def archive_file(folder, name, *lines):
    """Lines are (sensor, time as published, count)."""
    body = "".join(f'r{n},{s},{c},"{t}",Quay\n' for n, (s, t, c) in enumerate(lines))
    return put(folder, name, ARCHIVE_HEAD + body)


def portal_file(folder, name, *lines):
    """Lines are (sensor, day, hour, count)."""
    body = "".join(f'{day},{c},{s},{h},"a, b"\n' for s, day, h, c in lines)
    return put(folder, name, PORTAL_HEAD + body)


def test_repeats_inside_and_across_archive_files_collapse(spark, tmp_path):
    folder = tmp_path / "archive"
    noon, night = "2012-02-29T12:00:00", "29/02/2012 11:00:00 PM"
    archive_file(folder, "one.csv", (3, noon, 18), (4, noon, 18), (3, noon, 18), (5, night, 0))
    archive_file(folder, "two.csv", (4, "February 29, 2012 12:00:00 PM", 18), (3, night, 250))
    kept = clean.one_per_key(read_count_files(spark, str(folder)))
    leap = date(2012, 2, 29)
    assert rows(kept) == {(3, leap, 12, 18), (4, leap, 12, 18), (5, leap, 23, 0), (3, leap, 23, 250)}


def test_a_key_with_three_counts_vanishes_for_its_sensor_alone(spark, tmp_path):
    first, last = "2016-12-31 22:00:00", "2017-01-02 06:00:00"
    path = archive_file(
        tmp_path, "a.csv",
        (8, first, 31), (8, first, 32), (8, first, 33), (7, first, 31),
        (8, last, 90), (8, last, 91), (7, last, 0), (7, last, 0),
    )
    staged = read_count_files(spark, path)
    assert rows(clean.one_per_key(staged)) == {(7, date(2016, 12, 31), 22, 31), (7, date(2017, 1, 2), 6, 0)}
    assert tuple(clean.conflict_report(staged).first()) == (2, date(2016, 12, 31), date(2017, 1, 2))


def test_the_store_shows_live_days_and_older_archive_days(spark, tmp_path):
    """Per whole day and source, whatever the sensor: the archive ends where live data begins."""
    root = str(tmp_path / "lake")
    archived = [(s, f"2022-06-{d:02d} 09:00:00", 10 * d + s) for s in (1, 2) for d in range(1, 7)]
    live = [(1, f"2022-06-{d:02d}", 9, 500 + d) for d in (4, 6, 8)]
    assert load(spark, root, archive_file(tmp_path, "a.csv", *archived), "historic") == 12
    assert load(spark, root, portal_file(tmp_path, "l.csv", *live), "live") == 3
    seen = {(r.source, r.sensor_id, r.date.day, r["count"]) for r in store.read_counts(spark, root).collect()}
    before = {("historic", s, d, 10 * d + s) for s in (1, 2) for d in (1, 2, 3)}
    assert seen == before | {("live", 1, d, 500 + d) for d in (4, 6, 8)}
    assert store.read_counts(spark, root, reconcile=False).count() == 15


def test_loading_a_file_twice_leaves_one_copy_of_it(spark, tmp_path):
    root = str(tmp_path / "lake")
    lines = [(s, "2022-06-04", h, s * h) for s in (1, 2) for h in range(24)]
    path = portal_file(tmp_path, "l.csv", *lines)
    assert [load(spark, root, path, "live") for _ in range(3)] == [48] * 3
    assert rows(store.read_counts(spark, root)) == {(s, date(2022, 6, 4), h, c) for s, _, h, c in lines}


def test_later_load_replaces_from_its_first_day_only(spark, tmp_path, make_counts):
    root = str(tmp_path / "lake")
    early = make_counts([(1, date(2024, 1, d), 8, d) for d in range(1, 11)]).drop("source")
    late = make_counts([(1, date(2024, 1, d), 8, 100 + d) for d in (6, 8)]).drop("source")
    store.append_counts(spark, root, early, "live")
    store.append_counts(spark, root, late, "live")
    counts = {r.date.day: r["count"] for r in store.read_counts(spark, root).collect()}
    assert counts == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 106, 8: 108}
    assert store.compact_counts(spark, root, "live") == 7
    assert {r.date.day: r["count"] for r in store.read_counts(spark, root).collect()} == counts


def test_store_agrees_with_plain_replacement(spark, tmp_path, make_counts):
    root = str(tmp_path / "lake")
    base = make_counts([(s, date(2024, 1, d), 8, d) for s in (1, 2) for d in range(1, 9)])
    batch = make_counts([(1, date(2024, 1, 5), 8, 50)]).drop("source")
    store.append_counts(spark, root, base.drop("source"), "live")
    store.append_counts(spark, root, batch, "live")
    assert rows(store.read_counts(spark, root)) == rows(incremental.replace_window(base, batch, "live"))


def test_unlisted_folder_of_a_broken_run_is_ignored(spark, tmp_path, make_counts):
    root = str(tmp_path / "lake")
    batch = make_counts([(1, date(2024, 1, 1), 8, 5)])
    store.append_counts(spark, root, batch.drop("source"), "live")
    # a run that died before writing its log row
    batch.withColumn("month", F.trunc("date", "MM")).drop("source").write.partitionBy("month").parquet(
        f"{root}/counts/source=live/load=2"
    )
    assert store.read_counts(spark, root).count() == 1
    store.append_counts(spark, root, batch.drop("source").withColumn("count", F.lit(6)), "live")
    assert [r["count"] for r in store.read_counts(spark, root).collect()] == [6]


def test_empty_batch_changes_nothing(spark, tmp_path, make_counts):
    base = make_counts([(1, date(2024, 1, 1), 8, 5)])
    nothing = base.where("false").drop("source")
    assert incremental.replace_window(base, nothing, "live").count() == 1
    root = str(tmp_path / "lake")
    store.append_counts(spark, root, base.drop("source"), "live")
    assert store.append_counts(spark, root, nothing, "live") == 0
    assert store.read_counts(spark, root).count() == 1


def test_reconcile_without_live_rows_keeps_the_archive(make_counts):
    archive = make_counts([(1, date(2020, 1, 1), 8, 5)], "historic")
    assert incremental.reconcile_sources(archive).count() == 1


def test_unknown_layout_names_its_columns(spark, tmp_path):
    path = put(tmp_path, "bad.csv", "foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="Unrecognised counts file format.*bar, foo.*bad.csv"):
        read_count_files(spark, path)


def test_files_with_other_column_order_bind_by_name(spark, tmp_path):
    folder = tmp_path / "landing"
    put(folder, "a.csv", "location_id,sensing_date,hourday,pedestriancount\n1,2024-02-01,5,10\n")
    put(folder, "b.CSV", "pedestriancount,hourday,extra,sensing_date,location_id\n20,6,q,2024-02-02,2\n")
    put(folder / "deep", "c.csv", "Location ID,Sensing-Date,HourDay,PedestrianCount\n3,2024-02-03,7,30\n")
    assert rows(read_count_files(spark, str(folder))) == {
        (1, date(2024, 2, 1), 5, 10),
        (2, date(2024, 2, 2), 6, 20),
        (3, date(2024, 2, 3), 7, 30),
    }
    assert read_as_text(spark, str(folder)).count() == 3


def test_hidden_files_are_no_data(spark, tmp_path):
    folder = tmp_path / "zip"
    put(folder, "a.csv", "location_id,sensing_date,hourday,pedestriancount\n1,2024-02-01,5,10\n")
    put(folder, "._a.csv", "junk")
    put(folder / "__MACOSX", "a.csv", "junk")
    put(folder, "notes.txt", "junk")
    assert read_count_files(spark, str(folder)).count() == 1
    (tmp_path / "none").mkdir()
    with pytest.raises(RuntimeError, match="No CSV files"):
        read_count_files(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(
    "text, value",
    [("950", 950), ("950.0", 950), ("3.7", 4), ("1e3", 1000), (" 7 ", 7), ("-2.5", -3),
     ("", None), ("n/a", None), ("NaN", None), ("99999999999", None), (None, None)],
)
def test_counts_as_text(spark, text, value):
    line = spark.createDataFrame(
        [("1", "2024-02-01", "5", text)],
        "location_id string, sensing_date string, hourday string, pedestriancount string",
    )
    assert typed_counts(line).first()["count"] == value


@pytest.mark.parametrize(
    "text, day, hour",
    [("November 01, 2019 05:00:00 PM", date(2019, 11, 1), 17),
     ("2019-11-01T05:00:00", date(2019, 11, 1), 5),
     ("2019-11-01 23:00:00", date(2019, 11, 1), 23),
     ("01/11/2019 12:00:00 AM", date(2019, 11, 1), 0),
     ("1 Nov 2019", None, None)],
)
def test_archive_time_formats(spark, text, day, hour):
    line = spark.createDataFrame([("4", text, "1")], "sensor_id string, date_time string, hourly_counts string")
    row = typed_counts(line).first()
    assert (row.date, row.hour) == (day, hour)


def test_gate_opens_at_one_percent_and_closes_above(spark):
    def staged(bad):
        return spark.range(100).select(
            F.when(F.col("id") < bad, None).otherwise(1).cast("int").alias("sensor_id"),
            F.lit(date(2024, 1, 1)).alias("date"),
            F.lit(5).cast("tinyint").alias("hour"),
            F.col("id").cast("int").alias("count"),
        )

    assert clean.check_quality(staged(1), "live") == 100
    with pytest.raises(ValueError, match="More than 1%"):
        clean.check_quality(staged(2), "live")


def test_invalid_hours_and_counts_fail_the_rule(spark):
    rows = [(1, date(2024, 1, 1), 24, 5), (1, date(2024, 1, 1), 5, -1), (1, None, 5, 1), (1, date(2024, 1, 1), 23, 0)]
    staged = spark.createDataFrame(rows, "sensor_id int, date date, hour tinyint, count int")
    assert tuple(clean.quality_counts(staged).first()) == (4, 3)


def test_refresh_windows(spark, make_counts):
    from tallygrid.sources import schemas

    empty_weather = spark.createDataFrame([], schemas.WEATHER_HOURLY)
    none = make_counts([]).where("false")
    first = incremental.refresh_windows(none, empty_weather, date(2026, 3, 10)).first()
    assert first.fetch_archive and first.live_since is None
    assert first.weather_start == date(2009, 5, 1) and first.weather_end == date(2026, 3, 3)
    counts = make_counts([(1, date(2020, 5, 5), 1, 1, "historic"), (1, date(2026, 3, 1), 1, 1, "live")])
    again = incremental.refresh_windows(counts, empty_weather, date(2026, 3, 10)).first()
    assert not again.fetch_archive and again.live_since == date(2026, 2, 15)
    assert again.calendar_end == date(2026, 6, 8)


def test_conflicts_are_observed_while_rows_are_stored(spark, tmp_path, caplog, monkeypatch):
    """One grouping of the batch, and the report is that of ``conflict_report``."""
    lines = [(s, f"2022-06-{d:02d}", h, c) for s in (1, 2) for d in (1, 2, 3) for h in (5, 6) for c in ([4, 9] if s == h - 4 and d > 1 else [4, 4])]
    staged = read_count_files(spark, portal_file(tmp_path, "l.csv", *lines))
    kept, report = clean.one_per_key_observed(staged)
    assert rows(kept) == rows(clean.one_per_key(staged)) and len(rows(kept)) == 8
    assert report.get == clean.conflict_report(staged).first().asDict()
    assert (report.get["keys"], report.get["first_date"].day, report.get["last_date"].day) == (4, 2, 3)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    with caplog.at_level("INFO", logger="tallygrid.plans.update"):
        assert load(spark, str(tmp_path / "lake"), portal_file(tmp_path, "l.csv", *lines), "live") == 8
    assert "dropped 4 sensor-hours of live" in caplog.text


def test_rows_of_counts_never_reach_the_header_pattern(spark, tmp_path):
    """The pattern runs over lines that hold a layout's words, not over every line."""
    from tallygrid.sources import count_files

    (tmp_path / "a.csv").write_text("﻿Sensor ID,Date-Time,HOURLY  counts\n1,\"March 01, 2020 09:00:00 AM\",5\n")
    (tmp_path / "b.csv").write_text("Location_ID,Sensing Date,HourDay,PedestrianCount,Note\n2,2020-03-01,9,7,sensor id\n")
    found = count_files._files_by_header(spark, [str(tmp_path)])
    assert sorted(len(header) for header in found) == [3, 5]
    pattern = []
    original = count_files.F.regexp_replace
    try:
        count_files.F.regexp_replace = lambda *a: pattern.append(a) or count_files.F.raise_error(a[0]).cast("string")
        (tmp_path / "a.csv").unlink()
        (tmp_path / "b.csv").write_text("1,2\n3,4\n")
        with pytest.raises(ValueError, match="Unrecognised"):
            count_files._files_by_header(spark, [str(tmp_path)])
    finally:
        count_files.F.regexp_replace = original
    assert pattern
