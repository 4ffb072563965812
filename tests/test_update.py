"""The update run from landed files to views."""

import json
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from tallygrid.plans.update import Landing, update
from tallygrid.sources import store

HEADER = "location_id,sensing_date,hourday,pedestriancount\n"


def portal(days, count):
    return HEADER + "".join(f"1,{d},{h},{count}\n" for d in days for h in (8, 9))


def landing_zone(tmp_path):
    for name in ("archive", "live", "weather"):
        (tmp_path / name).mkdir()
    (tmp_path / "archive" / "old.csv").write_text(
        "Sensor_ID,Date_Time,Hourly_Counts\n"
        + "".join(f'1,"October {d:02d}, 2025 08:00:00 AM",{d}\n' for d in range(1, 21))
    )
    (tmp_path / "live" / "new.csv").write_text(portal([f"2025-10-{d}" for d in range(16, 31)], 500))
    (tmp_path / "weather" / "a.json").write_text(
        json.dumps({"hourly": {"time": ["2025-10-15T21:00", "2025-10-15T22:00"], "temperature_2m": [11.0, 12.0]}})
    )
    (tmp_path / "sensors.csv").write_text("Location_ID,Sensor_Description,Latitude,Longitude,Note\n1,Hall,-37.81,144.96,x\n")
    (tmp_path / "holidays.csv").write_text("date,holiday_name\n2025-11-04,Cup Day\n")
    at = lambda name: str(tmp_path / name)
    return Landing(at("archive"), at("live"), at("sensors.csv"), at("weather"), at("holidays.csv"))


def test_update_builds_and_then_only_adds(spark, tmp_path):
    root, landing = str(tmp_path / "lake"), landing_zone(tmp_path)
    summary = {r.source: (r["rows"], r.first_date, r.last_date) for r in update(spark, root, landing, date(2025, 11, 1)).collect()}
    assert summary == {
        "historic": (15, date(2025, 10, 1), date(2025, 10, 15)),  # live starts on the 16th
        "live": (30, date(2025, 10, 16), date(2025, 10, 30)),
    }
    assert store.read_table(spark, root, "sensors").first().sensor_description == "Hall"
    assert store.read_weather_hourly(spark, root).count() == 2
    calendar = store.read_table(spark, root, "calendar")
    assert calendar.agg(F.min("date"), F.max("date")).first() == (date(2009, 1, 1), date(2026, 1, 30))

    # a second run: corrected recent days, nothing else touched
    (tmp_path / "live" / "new.csv").write_text(portal(["2025-10-10", "2025-10-29", "2025-10-31"], 7))
    update(spark, root, landing, date(2025, 11, 2))
    live = store.read_counts(spark, root).where(F.col("source") == "live")
    by_day = {r.date.day: r["count"] for r in live.where("hour = 8").collect()}
    # the window starts 14 days before 30 October, so the row of the 10th is not taken
    assert 10 not in by_day and by_day[16] == 500 and by_day[28] == 500
    assert by_day[29] == 7 and 30 not in by_day and by_day[31] == 7
    assert store.read_counts(spark, root).where(F.col("source") == "historic").count() == 15

    # the views were renewed by the second run
    row = spark.sql("SELECT * FROM hourly WHERE date = '2025-10-16' AND hour = 8").first()
    assert row["count"] == 500 and row.temperature == 11.0
    assert spark.sql("SELECT * FROM counts WHERE date = '2025-10-31'").count() == 2
    assert spark.catalog.tableExists("calendar") and spark.catalog.tableExists("weather")


def test_month_pruning_reaches_the_scan(spark, tmp_path, make_counts):
    from tallygrid.functions.dates import between_days

    root = str(tmp_path / "lake")
    rows = make_counts([(1, date(2024, m, 1), 8, m) for m in range(1, 13)]).drop("source")
    store.append_counts(spark, root, rows, "live")
    some = between_days(store.read_counts(spark, root), date(2024, 3, 1), date(2024, 4, 30))
    assert some.count() == 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1][:300]


def test_calendar_is_built_without_a_holiday_file(spark, tmp_path):
    root, landing = str(tmp_path / "lake"), landing_zone(tmp_path)
    (tmp_path / "events.csv").write_text("event,start,end,note\nwhite_night,2025-03-01,2025-03-02,x\n")
    update(spark, root, replace(landing, holidays=None, events=str(tmp_path / "events.csv")), date(2025, 11, 1))
    days = {r.date: r for r in store.read_table(spark, root, "calendar").collect()}
    assert days[date(2025, 3, 2)].event_white_night and not days[date(2025, 3, 3)].event_white_night
    assert not any(r.is_holiday for r in days.values())
