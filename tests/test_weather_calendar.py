"""Weather rows and views, calendar flags."""

import json
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import calendar as cal
from tallygrid.operators import incremental, weather
from tallygrid.sources import reference_files, schemas


@pytest.fixture
def payload(spark, tmp_path):
    def make(hourly):
        path = tmp_path / f"response-{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps({"latitude": -37.8, "hourly": hourly}, indent=1))
        return weather.payload_rows(reference_files.read_weather_payload(spark, str(path)))

    return make


def year_of(zone, year):
    """Every UTC hour that falls in a local year, with what ``zoneinfo`` makes of it."""
    begun, over = (datetime(y, 1, 1, tzinfo=ZoneInfo(zone)).astimezone(UTC) for y in (year, year + 1))
    hours = [begun + timedelta(hours=n) for n in range(int((over - begun) / timedelta(hours=1)))]
    return hours, [h.astimezone(ZoneInfo(zone)) for h in hours]


@pytest.mark.parametrize("zone", ["Australia/Melbourne", "America/Santiago", "Australia/Lord_Howe", "Asia/Kolkata"])
def test_local_hours_of_a_year_are_those_of_the_time_zone(spark, zone):
    hours, local = year_of(zone, 2018)
    stamps = [(h.replace(tzinfo=None),) for h in hours]
    found = weather.local_hours(spark.createDataFrame(stamps, "ts_utc timestamp_ntz"), zone).collect()
    assert {r.ts_utc: (r.date, r.hour) for r in found} == {
        h.replace(tzinfo=None): (w.date(), w.hour) for h, w in zip(hours, local)
    }


def test_the_view_merges_the_hours_of_a_long_day(payload):
    """Brute force over a day of 25 hours: means of levels, sums of amounts, one row per local hour."""
    hours, local = year_of("Australia/Melbourne", 2019)
    long_day = max({w.date() for w in local}, key=lambda d: sum(w.date() == d for w in local))
    own = [(h, w.hour) for h, w in zip(hours, local) if w.date() == long_day]
    warm = [20.5 - 0.75 * n + (n % 4) for n in range(len(own))]
    wet = [(n * 7 % 5) / 10 for n in range(len(own))]
    found = weather.weather_view(
        payload({"time": [f"{h:%Y-%m-%dT%H:%M}" for h, _ in own], "temperature_2m": warm, "precipitation": wet})
    ).where(F.col("date") == F.lit(long_day))
    by_hour = {r.hour: r for r in found.collect()}
    assert len(own) == 25 and set(by_hour) == set(range(24))
    for hour, row in by_hour.items():
        at = [n for n, (_, h) in enumerate(own) if h == hour]
        assert row.temperature == pytest.approx(sum(warm[n] for n in at) / len(at))
        assert row.precipitation_mm == pytest.approx(sum(wet[n] for n in at))
        assert row.rain_mm is None and row.wind_speed is None  # not in the response


BATCH = {
    "time": ["2031-07-04T21:00", "2031-07-04T22:00", "2031-07-04T23:00"],
    "temperature_2m": [15.0, 13.0, 12.5],
    "precipitation": [0.4, 0.1, 0.0],
}


def test_upsert_replaces_from_first_hour(spark, payload):
    base = payload(BATCH)
    base = incremental.weather_columns(base)
    batch = payload({"time": ["2031-07-04T22:00"], "temperature_2m": [20.0]})
    merged = incremental.upsert_weather(base, batch).orderBy("ts_utc").collect()
    assert [r.temperature_2m for r in merged] == [15.0, 20.0]
    assert merged[1].precipitation is None
    untouched = incremental.upsert_weather(base, batch.where("false"))
    assert untouched.count() == 3


def view_rows(spark, rows):
    full = [(d, h, *[float(v)] * 7) for d, h, v in rows]
    names = ["date date", "hour tinyint", *[f"{c} double" for c in weather.VIEW_COLUMNS]]
    return spark.createDataFrame(full, ", ".join(names))


def test_typical_weather_is_a_band_without_wrap(spark):
    view = view_rows(
        spark,
        [(date(2020, 1, 1), 5, 10), (date(2021, 1, 4), 5, 20), (date(2021, 1, 8), 5, 90),
         (date(2020, 12, 30), 5, 50)],
    )
    days = spark.createDataFrame([(date(2022, 1, 2),)], "date date")
    row = weather.typical_weather(view, days).first()
    assert row.temperature == 15.0 and row.hour == 5


def test_supplied_weather_needs_enough_hours(spark):
    full, short = date(2024, 1, 1), date(2024, 1, 2)
    supplied = view_rows(spark, [(full, h, 1) for h in range(20)] + [(short, h, 2) for h in range(19)])
    typical = view_rows(spark, [(d, h, 9) for d in (full, short) for h in range(24)])
    chosen = weather.choose_weather(supplied, typical)
    sizes = {(r.date, r.weather_source): r["n"] for r in chosen.groupBy("date", "weather_source").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(full, "supplied"): 20, (short, "typical"): 24}


def test_hours_without_weather_stay(spark, make_counts):
    counts = make_counts([(1, date(2024, 1, 1), 5, 3), (1, date(2024, 1, 1), 6, 4)])
    joined = weather.hourly_view(counts, view_rows(spark, [(date(2024, 1, 1), 5, 7)]))
    assert {(r.hour, r.temperature) for r in joined.collect()} == {(5, 7.0), (6, None)}


@pytest.fixture
def small_calendar(spark, tmp_path):
    (tmp_path / "terms.csv").write_text(
        "year,term,start,end,source\n2031,1,2031-02-03,2031-04-11,x\n2031,2,2031-04-28,2031-06-27,x\n"
    )
    (tmp_path / "events.csv").write_text(
        "event,start,end,note\nriver_fair,2031-04-09,2031-04-12,x\nriver_fair,2031-04-12,2031-04-13,y\n"
        "Late Show,2031-04-20,2031-04-18,backwards\n"
    )
    (tmp_path / "holidays.csv").write_text(
        "date,holiday_name\n2031-04-14,Regatta Day\n2031-04-14,Founders Day\n2031-04-14,Regatta Day\n"
    )

    def build(start, end, names=("harvest",)):
        return cal.build_calendar(
            cal.day_spine(spark, start, end),
            reference_files.read_holidays(spark, str(tmp_path / "holidays.csv")),
            reference_files.read_terms(spark, str(tmp_path / "terms.csv")),
            reference_files.read_events(spark, str(tmp_path / "events.csv")),
            names,
        )

    return build


def test_spellings_of_one_column_are_one_event(spark, small_calendar):
    rows = small_calendar(date(2031, 4, 8), date(2031, 4, 14), ("River Fair", "river-fair", "harvest", "Harvest!"))
    flags = [c for c in rows.columns if c.startswith("event_")]
    assert flags == ["event_river_fair", "event_harvest", "event_late_show"]
    assert {r.date.day for r in rows.where("event_river_fair").collect()} == {9, 10, 11, 12, 13}
    assert rows.where("event_harvest").count() == 0
    days = [(n, date(2031, 5, d), date(2031, 5, d)) for d, n in enumerate(["Grand Prix", "grand_prix", None], 1)]
    events = spark.createDataFrame(days, schemas.EVENTS)
    none = spark.createDataFrame([], schemas.TERMS), spark.createDataFrame([], schemas.HOLIDAYS)
    spine = cal.day_spine(spark, date(2031, 5, 1), date(2031, 5, 4))
    built = cal.build_calendar(spine, none[1], none[0], events, ("grand_prix",))
    assert {r.date.day for r in built.where("event_grand_prix").collect()} == {1, 2}


def test_every_event_of_the_table_gets_a_flag(small_calendar):
    rows = small_calendar(date(2031, 4, 8), date(2031, 4, 22))
    assert [c for c in rows.columns if c.startswith("event_")] == ["event_harvest", "event_late_show", "event_river_fair"]
    fair = {r.date.day for r in rows.collect() if r.event_river_fair}
    assert fair == {9, 10, 11, 12, 13}
    assert not any(r.event_harvest or r.event_late_show for r in rows.collect())


def test_terms_and_the_break_between_them(small_calendar):
    days = {r.date.day: r.school_term for r in small_calendar(date(2031, 4, 10), date(2031, 4, 30)).collect()}
    assert [d for d, term in sorted(days.items()) if term] == [10, 11, 28, 29, 30]
    assert small_calendar(date(2033, 4, 10), date(2033, 4, 10)).first().school_term is None


def test_several_holidays_of_a_day_keep_their_names(small_calendar):
    row = small_calendar(date(2031, 4, 14), date(2031, 4, 14)).first()
    assert row.holiday_name == "Founders Day; Regatta Day" and row.is_holiday


def test_an_end_before_the_start_gives_no_day(small_calendar):
    assert small_calendar(date(2031, 4, 14), date(2031, 4, 1)).count() == 0


def test_days_around_a_holiday(small_calendar):
    rows = cal.with_holiday_neighbours(small_calendar(date(2031, 4, 12), date(2031, 4, 15)))
    got = {r.date.day: (r.day_before_holiday, r.day_after_holiday) for r in rows.collect()}
    assert got == {12: (False, False), 13: (True, False), 14: (False, False), 15: (False, True)}
    assert cal.holiday_on(rows, date(2031, 4, 14)).first().holiday_name.startswith("Founders")


def test_known_reference_tables(spark):
    assert reference_files.known_terms(spark).count() == 16
    assert reference_files.known_events(spark).select("event").distinct().count() == 6
    assert reference_files.known_terms(spark).schema == schemas.TERMS


def test_sensor_file_names_are_normalised(spark, tmp_path):
    path = tmp_path / "sensors.csv"
    path.write_text('Location_ID,Sensor Description,Latitude,Longitude,Note\n4,"Hall, West",-37.81,144.96,\n')
    row = reference_files.read_sensors(spark, str(path)).first()
    assert (row.location_id, row.sensor_description, row.latitude, row.note) == (4, "Hall, West", -37.81, None)
