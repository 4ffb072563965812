"""SQL for DuckDB that must return what the named queries return.

``STEPS`` are named common table expressions (all end in ``_t``); a query lists
only its final SELECT and pulls in the steps it mentions.
"""

from __future__ import annotations

import re

STEPS: dict[str, str] = {}
ORACLES: dict[str, str] = {}

MEASURES = (
    "temperature_2m",
    "apparent_temperature",
    "precipitation",
    "rain",
    "relative_humidity_2m",
    "cloud_cover",
    "wind_speed_10m",
)
VIEW = (
    "temperature",
    "apparent_temperature",
    "precipitation_mm",
    "rain_mm",
    "humidity",
    "cloud_cover",
    "wind_speed",
)
EVENTS = ("urgent", "high", "medium", "not_specified", "low")
LAGS = (35, 42, 49, 56)
BASE = "date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"
RECENT = "date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'"
WINDOWS = {"daily": (0, 23), "am_peak": (6, 6), "lunch": (12, 12), "pm_peak": (18, 18), "evening": (0, 0)}
OTHER_DAYS = ("Mon", "Tue", "Thu", "Fri", "Sat", "Sun")


def r6(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


def r6_all(*names: str, prefix: str = "") -> str:
    return ", ".join(r6(prefix + n, n) for n in names)


def with_steps(body: str) -> str:
    """Prefix ``body`` with the steps it needs, in dependency order."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for name in re.findall(r"\b\w+_t\b", sql):
            if name in STEPS and name not in seen:  # a recursive step names itself
                seen.add(name)
                visit(STEPS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    recursive = "RECURSIVE " if any(f"FROM {n}" in STEPS[n] for n in needed) else ""
    steps = f"WITH {recursive}" + ",\n".join(f"{n} AS ({STEPS[n]})" for n in needed)
    if body.startswith("WITH "):  # its own steps follow the shared ones
        return f"{steps},\n{body.removeprefix('WITH ')}"
    return f"{steps}\n{body}"


def oracle(name: str, body: str) -> None:
    ORACLES[name] = with_steps(body)


# --- tables ----------------------------------------------------------------------

STEPS["line_t"] = """
    SELECT l_suppkey, CAST(l_suppkey // 20 AS INTEGER) AS site, CAST(l_shipdate AS DATE) AS date,
           l_linenumber, l_quantity, l_returnflag, l_discount
    FROM lineitem"""
STEPS["ship_t"] = """
    SELECT site AS sensor_id, date, CAST((l_linenumber % 4) * 6 AS TINYINT) AS hour,
           CAST(CASE WHEN dayofyear(date) % 37 = 0 AND site % 5 = 0 THEN 0
                     ELSE sum(l_quantity) END AS INTEGER) AS count,
           CASE WHEN date < DATE '1999-01-01' THEN 'historic' ELSE 'live' END AS source
    FROM line_t GROUP BY site, date, l_linenumber % 4"""
STEPS["raw_t"] = """
    SELECT CAST(l_suppkey AS INTEGER) AS sensor_id, date, CAST(l_linenumber AS TINYINT) AS hour,
           CASE WHEN l_returnflag = 'R' AND l_discount >= 0.1 THEN NULL
                ELSE CAST(l_quantity AS INTEGER) END AS count
    FROM line_t"""
STEPS["archive_t"] = """
    SELECT CAST(l_suppkey AS INTEGER) AS sensor_id, date,
           CAST(l_linenumber * 3 AS TINYINT) AS hour, CAST(l_quantity AS INTEGER) AS count
    FROM line_t"""
STEPS["web_t"] = """
    SELECT CAST(user_id // 50 AS INTEGER) AS sensor_id, CAST(ts AS DATE) AS date,
           CAST(hour(ts) AS TINYINT) AS hour, CAST(count(*) AS INTEGER) AS count
    FROM events GROUP BY ALL"""

_WEATHER = """
    SELECT ts_utc, CAST(local AS DATE) AS date, CAST(hour(local) AS TINYINT) AS hour,
           CAST(total % 240 - 32 AS DOUBLE) / 4 AS temperature_2m,
           CAST(total % 220 - 28 AS DOUBLE) / 4 AS apparent_temperature,
           CAST(greatest(peak % 40 - 20, 0) AS DOUBLE) / 4 AS precipitation,
           CAST(greatest(peak % 40 - 24, 0) AS DOUBLE) / 4 AS rain,
           CAST(peak % 400 AS DOUBLE) / 4 AS relative_humidity_2m,
           CAST(total % 400 AS DOUBLE) / 4 AS cloud_cover,
           CAST(n % 160 AS DOUBLE) / 4 AS wind_speed_10m
    FROM (SELECT ts_utc, timezone('Australia/Melbourne', timezone('UTC', ts_utc)) AS local,
                 total, peak, n
          FROM (SELECT {stamp} AS ts_utc, CAST(sum(v) AS BIGINT) AS total, max(v) AS peak,
                       count(*) AS n
                FROM (SELECT *, CAST(round({value}) AS BIGINT) AS v FROM {table}) GROUP BY 1))"""
STEPS["order_weather_t"] = _WEATHER.format(
    stamp="o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT))",
    value="o_totalprice",
    table="orders",
)
STEPS["event_weather_t"] = _WEATHER.format(
    stamp="date_trunc('hour', ts)", value="value", table="events"
)
_VIEW = ", ".join(
    f"{'sum' if m in ('precipitation', 'rain') else 'avg'}({m}) AS {v}"
    for m, v in zip(MEASURES, VIEW)
)
STEPS["order_view_t"] = f"SELECT date, hour, {_VIEW} FROM order_weather_t GROUP BY date, hour"
STEPS["event_view_t"] = f"SELECT date, hour, {_VIEW} FROM event_weather_t GROUP BY date, hour"

STEPS["place_t"] = """
    SELECT CAST(s_suppkey // 20 AS INTEGER) AS sensor_id, min(s_name) AS name,
           -37.8190 + round(max(s_acctbal)) / 1200000 AS latitude,
           144.9530 + round(min(s_acctbal)) / 1200000 AS longitude,
           CASE WHEN min(s_nationkey) = 0 THEN 'Pushbox Upgrade' END AS note
    FROM supplier GROUP BY 1"""
STEPS["holiday_t"] = """
    SELECT * FROM (
        SELECT date, CASE strftime(date, '%m-%d')
            WHEN '01-01' THEN 'New Year''s Day' WHEN '01-26' THEN 'Australia Day'
            WHEN '04-25' THEN 'Anzac Day' WHEN '12-25' THEN 'Christmas Day'
            WHEN '12-26' THEN 'Boxing Day' END AS holiday_name
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders))
    WHERE holiday_name IS NOT NULL"""
STEPS["term_t"] = """
    SELECT year(d) AS y, quarter(d) AS q, min(d) + 20 AS first_day, max(d) - 10 AS last_day
    FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
    WHERE year(d) BETWEEN 1996 AND 2000 GROUP BY 1, 2 HAVING min(d) + 20 <= max(d) - 10"""
STEPS["happening_t"] = """
    SELECT replace(lower(substr(o_orderpriority, 3)), ' ', '_') AS event,
           CAST(arg_max(o_orderdate, o_orderkey) AS DATE) AS first_day
    FROM orders GROUP BY o_orderpriority, year(o_orderdate)"""
STEPS["day_t"] = """
    SELECT CAST(unnest(generate_series(min(date), max(date) + 90, INTERVAL 1 DAY)) AS DATE) AS date
    FROM line_t"""
STEPS["calendar_t"] = (
    """
    SELECT d.date, h.holiday_name, h.holiday_name IS NOT NULL AS is_holiday,
           CASE WHEN EXISTS (SELECT 1 FROM term_t WHERE y = year(d.date))
                THEN EXISTS (SELECT 1 FROM term_t WHERE d.date BETWEEN first_day AND last_day)
           END AS school_term, """
    + ", ".join(
        f"EXISTS (SELECT 1 FROM happening_t WHERE event = '{e}' "
        f"AND d.date BETWEEN first_day AND first_day + 2) AS event_{e}"
        for e in EVENTS
    )
    + " FROM day_t d LEFT JOIN holiday_t h ON h.date = d.date"
)

# --- ingest and cleaning ---------------------------------------------------------

oracle("build_counts", "SELECT * FROM ship_t")
oracle("stored_update", "SELECT * FROM ship_t")
oracle(
    "sensors_file",
    "SELECT sensor_id AS location_id, name AS sensor_description, latitude, longitude, note FROM place_t",
)
_CALENDAR = "SELECT * REPLACE (CAST(CAST(school_term AS INTEGER) AS DOUBLE) AS school_term) FROM calendar_t"
oracle("reference_files", _CALENDAR)
oracle("calendar_table", _CALENDAR)
oracle(
    "hourly_sql",
    f"""SELECT c.sensor_id, c.date, c.hour, c.count, {r6_all(*VIEW, prefix='w.')}
        FROM ship_t c LEFT JOIN order_view_t w ON w.date = c.date AND w.hour = c.hour""",
)
oracle(
    "clean_counts",
    """SELECT sensor_id, date, hour, any_value(count) AS count
       FROM (SELECT DISTINCT * FROM raw_t WHERE count IS NOT NULL)
       GROUP BY sensor_id, date, hour HAVING count(*) = 1""",
)
oracle(
    "clean_archive_counts",
    """SELECT sensor_id, date, hour, any_value(count) AS count
       FROM (SELECT DISTINCT * FROM archive_t) GROUP BY sensor_id, date, hour HAVING count(*) = 1""",
)
for _name, _from in {
    "csv_portal_counts": "raw_t WHERE count IS NOT NULL",
    "csv_mixed_order": "raw_t WHERE count IS NOT NULL",
    "csv_archive_counts": "archive_t",
}.items():
    oracle(
        _name,
        f"""SELECT sensor_id, date, hour, min(count) AS count FROM {_from}
            GROUP BY sensor_id, date, hour HAVING min(count) = max(count)""",
    )
oracle(
    "conflict_report",
    """SELECT count(*) AS keys, min(date) AS first_date, max(date) AS last_date
       FROM (SELECT sensor_id, date, hour FROM raw_t
             GROUP BY ALL HAVING count(DISTINCT count) >= 2)""",
)
oracle(
    "quality_gate_counts",
    """SELECT count(*) AS total_rows, count(*) FILTER (WHERE count IS NULL) AS bad_rows
       FROM raw_t""",
)
oracle(
    "replace_window",
    """SELECT sensor_id, date, hour, source,
              CAST(count + CASE WHEN date >= DATE '2000-06-01' THEN 1 ELSE 0 END AS INTEGER) AS count
       FROM ship_t""",
)
oracle(
    "reconcile_sources",
    """SELECT sensor_id, date, hour, count, source FROM ship_t""",
)
_SUMMARY = """SELECT source, count(*) AS rows, count(DISTINCT sensor_id) AS sensors,
              min(date) AS first_date, max(date) AS last_date FROM ship_t GROUP BY source"""
oracle("dataset_summary", _SUMMARY)
oracle("stored_summary", _SUMMARY)
oracle(
    "weather_span",
    """SELECT count(*) AS hours, min(date) AS first_date, max(date) AS last_date
       FROM order_weather_t""",
)
oracle(
    "refresh_plan",
    """SELECT false AS fetch_archive,
              (SELECT max(date) - 14 FROM ship_t WHERE source = 'live') AS live_since,
              (SELECT CAST(max(ts_utc) AS DATE) - 2 FROM order_weather_t) AS weather_start,
              DATE '2002-01-03' AS weather_end,
              (SELECT CAST(max(ts_utc) AS DATE) - 2 FROM order_weather_t) <= DATE '2002-01-03'
                  AS fetch_weather,
              DATE '2009-01-01' AS calendar_start, DATE '2002-01-10' + 90 AS calendar_end""",
)
oracle("live_since", "SELECT * FROM ship_t WHERE date >= DATE '2000-06-01'")

# --- weather ---------------------------------------------------------------------

oracle("weather_local", "SELECT * FROM order_weather_t")
oracle("weather_payload", "SELECT * FROM order_weather_t")
oracle("weather_by_local_hour", f"SELECT date, hour, {r6_all(*VIEW)} FROM order_view_t")
oracle(
    "hourly_joined",
    f"""SELECT c.sensor_id, c.date, c.hour, c.count, {r6_all(*VIEW, prefix='w.')}
        FROM web_t c LEFT JOIN event_view_t w ON w.date = c.date AND w.hour = c.hour""",
)
oracle(
    "weather_upsert",
    """SELECT ts_utc, date, hour,
              temperature_2m + CASE WHEN ts_utc >= first THEN 1 ELSE 0 END AS temperature_2m,
              apparent_temperature, precipitation, rain, relative_humidity_2m, cloud_cover,
              CASE WHEN ts_utc < first THEN wind_speed_10m END AS wind_speed_10m
       FROM order_weather_t, (SELECT TIMESTAMP '2000-01-01' AS first)""",
)
STEPS["typical_t"] = f"""
    SELECT h.date, w.hour, {', '.join(f'avg(w.{v}) AS {v}' for v in VIEW)}
    FROM holiday_t h JOIN order_view_t w ON abs(dayofyear(w.date) - dayofyear(h.date)) <= 3
    GROUP BY h.date, w.hour"""
oracle("typical_weather", f"SELECT date, hour, {r6_all(*VIEW)} FROM typical_t")
oracle(
    "weather_choice",
    f"""WITH given AS (SELECT w.* FROM order_view_t w WHERE date IN (SELECT date FROM holiday_t)),
             full_days AS (SELECT date FROM given GROUP BY date HAVING count(*) >= 6)
        SELECT date, hour, {r6_all(*VIEW)}, 'supplied' AS weather_source
        FROM given WHERE date IN (SELECT date FROM full_days)
        UNION ALL
        SELECT date, hour, {r6_all(*VIEW)}, 'typical'
        FROM typical_t WHERE date NOT IN (SELECT date FROM full_days)""",
)

# --- calendar --------------------------------------------------------------------

oracle(
    "calendar",
    "SELECT * REPLACE (CAST(CAST(school_term AS INTEGER) AS DOUBLE) AS school_term) FROM calendar_t",
)
oracle(
    "odd_calendar",
    """WITH d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
                  FROM line_t),
            h AS (SELECT DISTINCT date FROM line_t WHERE strftime(date, '%m-%d') = '01-26'),
            e AS (SELECT l_returnflag AS flag, min(date) AS s FROM line_t GROUP BY l_returnflag, year(date))
       SELECT d.date, CASE WHEN h.date IS NOT NULL THEN 'Australia Day; Survival Day' END AS holiday_name,
              h.date IS NOT NULL AS is_holiday,
              CAST(CASE WHEN EXISTS (SELECT 1 FROM term_t WHERE y = year(d.date))
                   THEN EXISTS (SELECT 1 FROM term_t WHERE d.date BETWEEN first_day AND last_day)
              END AS INTEGER)::DOUBLE AS school_term,
              EXISTS (SELECT 1 FROM e WHERE flag = 'A' AND d.date BETWEEN s AND s + 2) AS event_flag_a,
              EXISTS (SELECT 1 FROM e WHERE flag = 'N' AND d.date BETWEEN s AND s + 2) AS event_flag_n,
              false AS event_flag_r
       FROM d LEFT JOIN h USING (date)""",
)
STEPS["near_holiday_t"] = """
    SELECT *, EXISTS (SELECT 1 FROM holiday_t h WHERE h.date = c.date + 1
                      AND h.date <= (SELECT max(date) FROM day_t)) AS day_before_holiday,
           EXISTS (SELECT 1 FROM holiday_t h WHERE h.date = c.date - 1
                   AND h.date >= (SELECT min(date) FROM day_t)) AS day_after_holiday
    FROM calendar_t c"""
oracle(
    "holiday_neighbours",
    "SELECT date, is_holiday, day_before_holiday, day_after_holiday FROM near_holiday_t",
)
oracle(
    "holiday_lookup", "SELECT date, holiday_name FROM calendar_t WHERE date = DATE '2000-12-25'"
)

# --- coverage --------------------------------------------------------------------

STEPS["coverage_t"] = f"""
    SELECT c.*, c.mean_recent / nullif(c.mean_base, 0) AS recent_vs_base,
           p.name, p.latitude, p.longitude, p.note
    FROM (SELECT sensor_id,
                 sum(CASE WHEN {BASE} THEN 1 ELSE 0 END) / 1464.0::DOUBLE AS cov_base,
                 sum(CASE WHEN {RECENT} THEN 1 ELSE 0 END) / 2924.0::DOUBLE AS cov_recent,
                 avg(CASE WHEN {BASE} THEN count END) AS mean_base,
                 avg(CASE WHEN {RECENT} THEN count END) AS mean_recent
          FROM ship_t GROUP BY sensor_id) c
    JOIN place_t p USING (sensor_id)"""
_COVERAGE = f"""sensor_id, {r6_all('cov_base', 'cov_recent', 'mean_base', 'mean_recent',
    'recent_vs_base', 'latitude', 'longitude')}, name, note"""
_SELECTED = """latitude BETWEEN -37.82 AND -37.809 AND longitude BETWEEN 144.952 AND 144.9745
    AND cov_base >= 0.5 AND cov_recent >= 0.5"""
oracle("sensor_coverage", f"SELECT {_COVERAGE} FROM coverage_t")
oracle(
    "sensor_selection",
    f"SELECT {_COVERAGE}, sensor_id <> 3 AS selected FROM coverage_t WHERE {_SELECTED}",
)
STEPS["complete_t"] = """
    SELECT sensor_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS hours,
           count(*) / (day(last_day(any_value(date))) * 4)::DOUBLE AS share
    FROM ship_t GROUP BY 1, 2"""
oracle("monthly_completeness", f"SELECT sensor_id, month, hours, {r6('share')} FROM complete_t")
oracle("stored_completeness", f"SELECT sensor_id, month, hours, {r6('share')} FROM complete_t")
_GRID = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)][: 6 * 12 + 11]
oracle(
    "completeness_grid",
    "SELECT sensor_id, min(month) AS first_month, "
    + ", ".join(
        f"""round(max(CASE WHEN month = DATE '{m}-01' THEN share END), 6) AS "{m}" """ for m in _GRID
    )
    + " FROM complete_t GROUP BY sensor_id",
)
STEPS["fault_t"] = """
    SELECT sensor_id, date FROM ship_t WHERE hour >= 8 AND hour <= 20
    GROUP BY sensor_id, date HAVING sum(count) = 0 AND count(*) > 1"""
oracle("fault_days", "SELECT * FROM fault_t")
oracle("stored_fault_days", "SELECT * FROM fault_t")
oracle(
    "suspicious_days",
    "SELECT sensor_id, count(*) AS suspicious_days FROM fault_t GROUP BY sensor_id",
)
oracle(
    "upgrade_compare",
    f"""SELECT coalesce(note LIKE '%Pushbox%', false) AS upgraded,
               {r6('avg(recent_vs_base)', 'mean_ratio')},
               {r6('median(recent_vs_base)', 'median_ratio')}, count(recent_vs_base) AS sensors
        FROM coverage_t WHERE {_SELECTED} AND sensor_id <> 3 GROUP BY 1""",
)
oracle("sensor_picker", "SELECT sensor_id, name FROM place_t")

# --- series and profiles ---------------------------------------------------------

STEPS["index_t"] = f"""
    SELECT date, avg(own) AS index, count(*) AS sensors
    FROM (SELECT d.date, 100 * d.mean / b.mean AS own
          FROM (SELECT sensor_id, date, avg(count) AS mean FROM ship_t
                GROUP BY sensor_id, date HAVING count(*) = 4) d
          JOIN (SELECT sensor_id, avg(count) AS mean FROM ship_t WHERE {BASE} GROUP BY 1) b
          USING (sensor_id))
    GROUP BY date"""
oracle("indexed_series", f"SELECT date, {r6('index')}, sensors FROM index_t")
oracle(
    "smoothed_series",
    f"""WITH axis AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))
                             AS DATE) AS date FROM index_t),
             full_axis AS (SELECT a.date, i.index FROM axis a LEFT JOIN index_t i USING (date))
        SELECT date, {r6('CASE WHEN count(index) OVER last28 >= 20 THEN avg(index) OVER last28 END', 'smooth')}
        FROM full_axis
        WINDOW last28 AS (ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)""",
)
oracle(
    "yearly_index",
    "SELECT CAST(year(date) AS INTEGER) AS year, round(avg(index)) AS index FROM index_t GROUP BY 1",
)
oracle(
    "monthly_steps",
    f"""WITH m AS (SELECT sensor_id, CAST(date_trunc('month', date) AS DATE) AS month,
                          avg(count) AS mean_count
                   FROM ship_t WHERE hour BETWEEN 8 AND 20 GROUP BY 1, 2),
             axis AS (SELECT sensor_id, CAST(unnest(generate_series(min(month), max(month),
                             INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY sensor_id)
        SELECT a.sensor_id, a.month, {r6('m.mean_count', 'mean_count')}
        FROM axis a LEFT JOIN m ON m.sensor_id = a.sensor_id AND m.month = a.month""",
)
oracle(
    "weekly_history",
    f"""WITH d AS (SELECT sensor_id, date, sum(count) AS people FROM ship_t
                   GROUP BY 1, 2 HAVING count(*) = 4),
             w AS (SELECT sensor_id, CAST(date_trunc('week', date) AS DATE) + 6 AS week,
                          avg(people) AS people FROM d GROUP BY 1, 2),
             axis AS (SELECT sensor_id, CAST(unnest(generate_series(min(week), max(week),
                             INTERVAL 7 DAY)) AS DATE) AS week FROM w GROUP BY sensor_id)
        SELECT a.sensor_id, a.week, {r6('w.people', 'people')}
        FROM axis a LEFT JOIN w ON w.sensor_id = a.sensor_id AND w.week = a.week""",
)
STEPS["scoped_t"] = f"""
    SELECT *, CASE WHEN {BASE} THEN '1996' ELSE 'recent' END AS period
    FROM ship_t WHERE {BASE} OR {RECENT}"""
oracle(
    "hourly_profile",
    f"""SELECT period, CASE strftime(date, '%a') WHEN 'Mon' THEN 'Monday' WHEN 'Fri' THEN 'Friday'
                 WHEN 'Sat' THEN 'Weekend' WHEN 'Sun' THEN 'Weekend' ELSE 'Tue–Thu' END AS day_type,
               hour, {r6('avg(count)', 'mean_count')}
        FROM scoped_t GROUP BY 1, 2, 3""",
)
oracle(
    "weekday_level",
    f"""SELECT CAST(dayofweek(date) AS INTEGER) AS dow, CAST(isodow(date) AS INTEGER) AS position,
               {r6(f'avg(count) FILTER (WHERE {BASE})', 'mean_base')},
               {r6(f'avg(count) FILTER (WHERE {RECENT})', 'mean_recent')},
               {r6(f'100 * avg(count) FILTER (WHERE {RECENT}) / avg(count) FILTER (WHERE {BASE})', 'pct_of_base')}
        FROM ship_t GROUP BY 1, 2""",
)
STEPS["relative_t"] = f"""
    SELECT s.sensor_id, s.date, s.hour, s.count, {', '.join(VIEW)}, s.period,
           CAST(dayofweek(s.date) AS INTEGER) AS dow, s.count / u.usual AS relative
    FROM scoped_t s
    JOIN order_view_t w ON w.date = s.date AND w.hour = s.hour
    JOIN (SELECT a.sensor_id, a.period, dayofweek(a.date) AS dow, a.hour, median(a.count) AS usual
          FROM scoped_t a JOIN order_view_t b ON b.date = a.date AND b.hour = a.hour
          GROUP BY ALL) u
      ON u.sensor_id = s.sensor_id AND u.period = s.period AND u.dow = dayofweek(s.date)
         AND u.hour = s.hour
    WHERE s.hour IN (12, 18) AND u.usual > 0"""
oracle(
    "relative_to_median",
    f"""SELECT sensor_id, date, hour, count, {r6_all(*VIEW)}, period, dow, {r6('relative')}
        FROM relative_t""",
)
oracle(
    "rain_effect",
    f"""SELECT CASE WHEN precipitation_mm <= 0 THEN 'Dry' WHEN precipitation_mm <= 1 THEN '0–1 mm'
                 WHEN precipitation_mm <= 3 THEN '1–3 mm' ELSE '3+ mm' END AS bucket,
               {r6('avg(relative)', 'mean_relative')}, count(*) AS hours
        FROM relative_t WHERE precipitation_mm <= 100 GROUP BY 1""",
)
oracle(
    "temperature_effect",
    f"""SELECT CASE WHEN temperature <= 10 THEN '<10°' WHEN temperature <= 15 THEN '10–15°'
                 WHEN temperature <= 20 THEN '15–20°' WHEN temperature <= 25 THEN '20–25°'
                 WHEN temperature <= 30 THEN '25–30°' WHEN temperature <= 35 THEN '30–35°'
                 ELSE '35°+' END AS bucket,
               {r6('avg(relative)', 'mean_relative')}, count(*) AS hours
        FROM relative_t WHERE temperature > -5 AND temperature <= 50 GROUP BY 1""",
)

# --- forecast features and scores ------------------------------------------------

STEPS["baseline_t"] = """
    SELECT t.sensor_id, t.date, t.hour, t.count, avg(p.count) AS baseline,
           count(p.count) AS baseline_weeks
    FROM ship_t t LEFT JOIN ship_t p
      ON p.sensor_id = t.sensor_id AND p.hour = t.hour AND t.date - p.date IN (35, 42, 49, 56)
    GROUP BY t.sensor_id, t.date, t.hour, t.count"""
oracle(
    "seasonal_baseline",
    f"SELECT sensor_id, date, hour, count, {r6('baseline')}, baseline_weeks FROM baseline_t",
)
STEPS["doy_t"] = """
    SELECT y.doy, s.level
    FROM (SELECT unnest(range(1, 367)) AS doy) y
    LEFT JOIN (
        SELECT dayofyear(d.date) AS doy, avg(d.total / m.mean) AS level
        FROM (SELECT sensor_id, date, sum(count) AS total FROM ship_t
              WHERE year(date) BETWEEN 1996 AND 1998
              GROUP BY sensor_id, date HAVING count(*) = 4) d
        JOIN (SELECT sensor_id, year(date) AS y, avg(total) AS mean
              FROM (SELECT sensor_id, date, sum(count) AS total FROM ship_t
                    GROUP BY sensor_id, date HAVING count(*) = 4)
              GROUP BY 1, 2) m
          ON m.sensor_id = d.sensor_id AND m.y = year(d.date)
        GROUP BY 1) s USING (doy)"""
STEPS["filled_t"] = """
    SELECT d.doy, coalesce(
        d.level,
        (SELECT b.level + (a.level - b.level) * (d.doy - b.doy) / (a.doy - b.doy)
         FROM (SELECT doy, level FROM doy_t WHERE level IS NOT NULL AND doy < d.doy
               ORDER BY doy DESC LIMIT 1) b,
              (SELECT doy, level FROM doy_t WHERE level IS NOT NULL AND doy > d.doy
               ORDER BY doy LIMIT 1) a),
        (SELECT level FROM doy_t WHERE level IS NOT NULL AND doy < d.doy
         ORDER BY doy DESC LIMIT 1)) AS level
    FROM doy_t d"""
STEPS["season_t"] = """
    SELECT c.doy, CASE WHEN count(n.level) = 7 THEN avg(n.level) END AS season
    FROM filled_t c JOIN filled_t n
      ON least((n.doy - c.doy + 366) % 366, (c.doy - n.doy + 366) % 366) <= 3
    GROUP BY c.doy"""
STEPS["season_change_t"] = (
    "SELECT CAST(s.doy AS INTEGER) AS doy, s.season, s.season / (("
    + " + ".join(f"p{i}.season" for i in LAGS)
    + ") / 4) AS season_change FROM season_t s "
    + " ".join(
        f"JOIN season_t p{i} ON p{i}.doy = (s.doy - {i} - 1 + 365) % 365 + 1" for i in LAGS
    )
)
oracle("season_index", f"SELECT CAST(doy AS INTEGER) AS doy, {r6('season')} FROM season_t")
oracle("season_features", f"SELECT doy, {r6_all('season', 'season_change')} FROM season_change_t")
STEPS["sound_t"] = """
    SELECT * FROM ship_t s
    WHERE NOT EXISTS (SELECT 1 FROM fault_t f WHERE f.sensor_id = s.sensor_id AND f.date = s.date)"""
_FLAGS = (
    "is_holiday",
    "day_before_holiday",
    "day_after_holiday",
    "school_term",
    *[f"event_{e}" for e in EVENTS],
)


def _features(target: str, weather: str) -> str:
    lag = "".join(
        f" LEFT JOIN sound_t l{i} ON l{i}.sensor_id = t.sensor_id AND l{i}.hour = t.hour "
        f"AND l{i}.date = t.date - {i}"
        for i in (*LAGS, 364)
    )
    return f"""
    SELECT t.sensor_id, t.date, t.hour, t.count, CAST(dayofweek(t.date) AS INTEGER) AS dow,
           CAST(month(t.date) AS INTEGER) AS month, CAST(dayofyear(t.date) AS INTEGER) AS doy,
           {', '.join(f'CAST(CAST(c.{f} AS INTEGER) AS DOUBLE) AS {f}' for f in _FLAGS)},
           {', '.join(f'w.{v}' for v in VIEW)},
           list_avg(list_filter([{', '.join(f'l{i}.count' for i in LAGS)}], lambda x: x IS NOT NULL))
               AS baseline,
           CAST(l35.count AS DOUBLE) AS lag_35, CAST(l42.count AS DOUBLE) AS lag_42,
           CAST(l364.count AS DOUBLE) AS lag_364,
           s.season, s.season_change
    FROM {target} t {lag}
    LEFT JOIN near_holiday_t c ON c.date = t.date
    LEFT JOIN {weather} w ON w.date = t.date AND w.hour = t.hour
    LEFT JOIN season_change_t s ON s.doy = dayofyear(t.date)"""


STEPS["target_t"] = "SELECT * FROM sound_t"
STEPS["feature_t"] = _features("target_t", "order_view_t")
STEPS["coming_t"] = """
    SELECT sensor_id, CAST(d AS DATE) AS date, CAST(h AS TINYINT) AS hour, CAST(NULL AS INTEGER) AS count
    FROM place_t, unnest((SELECT generate_series(max(date) + 1, max(date) + 14, INTERVAL 1 DAY)
                          FROM ship_t)) x(d),
         unnest([0, 6, 12, 18]) y(h)"""
STEPS["coming_weather_t"] = f"""
    SELECT f.date, w.hour, {', '.join(f'avg(w.{v}) AS {v}' for v in VIEW)}
    FROM (SELECT DISTINCT date FROM coming_t) f
    JOIN order_view_t w ON abs(dayofyear(w.date) - dayofyear(f.date)) <= 3
    GROUP BY f.date, w.hour"""
STEPS["coming_feature_t"] = _features("coming_t", "coming_weather_t")
_FEATURE_ROW = f"""sensor_id, date, hour, count, dow, month, doy, {', '.join(_FLAGS)},
    {r6_all(*VIEW, 'baseline', 'season', 'season_change')}, lag_35, lag_42, lag_364"""
oracle("feature_dataset", f"SELECT {_FEATURE_ROW} FROM feature_t")
oracle(
    "future_dataset",
    f"SELECT * REPLACE (CAST(count AS DOUBLE) AS count) FROM (SELECT {_FEATURE_ROW} FROM coming_feature_t)",
)

_SCORE = f"""{r6('avg(abs(baseline - count))', 'mae')},
    {r6('sum(abs(baseline - count)) / sum(count)', 'wape')}, count(*) AS hours"""
oracle("score_overall", f"SELECT {_SCORE} FROM baseline_t WHERE baseline IS NOT NULL")
oracle(
    "score_by_sensor",
    f"SELECT sensor_id, {_SCORE} FROM baseline_t WHERE baseline IS NOT NULL GROUP BY sensor_id",
)
oracle(
    "score_by_month",
    f"""SELECT strftime(date, '%Y-%m') AS month, {_SCORE} FROM baseline_t
        WHERE baseline IS NOT NULL GROUP BY 1""",
)
oracle(
    "score_by_holiday",
    f"""SELECT c.is_holiday, {_SCORE} FROM baseline_t b LEFT JOIN calendar_t c USING (date)
        WHERE baseline IS NOT NULL GROUP BY 1""",
)
STEPS["compared_t"] = """
    SELECT *, CAST(coalesce(lag_364, lag_35) AS DOUBLE) AS model FROM feature_t
    WHERE baseline IS NOT NULL"""
_COMPARE = f"""
    {r6('avg(abs(baseline - count))', 'baseline_mae')},
    {r6('avg(abs(model - count))', 'model_mae')},
    {r6('sum(abs(baseline - count)) / sum(count)', 'baseline_wape')},
    {r6('sum(abs(model - count)) / sum(count)', 'model_wape')}, count(*) AS hours,
    {r6('1 - avg(abs(model - count)) / avg(abs(baseline - count))', 'reduction')}"""
oracle("model_comparison", f"SELECT {_COMPARE} FROM compared_t WHERE model IS NOT NULL")
oracle(
    "model_comparison_by_sensor",
    f"""SELECT sensor_id, any_value(name) AS name, {_COMPARE}
        FROM compared_t LEFT JOIN place_t USING (sensor_id)
        WHERE model IS NOT NULL GROUP BY sensor_id""",
)
oracle(
    "model_comparison_by_month",
    f"""SELECT strftime(date, '%Y-%m') AS month, {_COMPARE} FROM compared_t
        WHERE model IS NOT NULL GROUP BY 1""",
)
oracle(
    "model_comparison_by_holiday",
    f"SELECT is_holiday, {_COMPARE} FROM compared_t WHERE model IS NOT NULL GROUP BY is_holiday",
)
oracle(
    "day_ahead_summary",
    f"""SELECT f.sensor_id, f.date, {r6('sum(f.lag_35)', 'forecast')},
               {r6('sum(f.baseline)', 'typical')}, {r6('max(f.temperature)', 'max_temp')},
               {r6('sum(f.precipitation_mm)', 'rain_mm')},
               {r6('CASE WHEN sum(f.baseline) > 0 THEN sum(f.lag_35) FILTER (f.baseline IS NOT NULL) / sum(f.baseline) - 1 END', 'change')},
               any_value(c.holiday_name) AS holiday_name
        FROM coming_feature_t f LEFT JOIN calendar_t c ON c.date = f.date
        GROUP BY f.sensor_id, f.date""",
)
# twelve months up to the newest count, each with all rows before it
_FOLDS = """WITH last AS (SELECT date_trunc('month', max(date))::DATE AS begun FROM ship_t),
     test AS (SELECT r.*, date_trunc('month', r.date)::DATE AS fold FROM feature_t r, last
              WHERE r.date >= last.begun - INTERVAL 11 MONTH),
     learned AS (SELECT m.fold, count(*) AS train_rows
                 FROM (SELECT DISTINCT fold FROM test) m JOIN feature_t e ON e.date < m.fold GROUP BY m.fold)"""
oracle(
    "backtest",
    f"""{_FOLDS}
        SELECT sensor_id, date, hour, CAST(count AS DOUBLE) AS count, {r6('baseline')}, train_rows,
               true AS has_forecast
        FROM test JOIN learned USING (fold)""",
)
oracle(
    "day_ahead",
    f"""SELECT f.sensor_id, f.date, {r6('sum(f.baseline)', 'typical')},
               {r6('max(f.temperature)', 'max_temp')}, {r6('sum(f.precipitation_mm)', 'rain_mm')},
               any_value(c.holiday_name) AS holiday_name, true AS has_forecast
        FROM coming_feature_t f LEFT JOIN calendar_t c ON c.date = f.date
        GROUP BY f.sensor_id, f.date""",
)
oracle(
    "backtest_folds",
    f"""{_FOLDS}
        SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows, any_value(train_rows) AS train_rows,
               CAST(sum(count) AS BIGINT) AS people, {r6('sum(baseline)', 'baseline')},
               CAST(0 AS BIGINT) AS bad_predictions
        FROM test JOIN learned USING (fold) GROUP BY 1""",
)
_SLICE = f"""
    {r6('sum(abs(baseline - count)) / sum(count)', 'baseline_wape')},
    {r6('sum(abs(model - count)) / sum(count) FILTER (WHERE model IS NOT NULL)', 'model_wape')},
    count(*) AS hours"""
_SLICES = {
    "All hours": "true",
    "Normal days": "is_holiday = 0",
    "Public holidays": "is_holiday = 1",
    "Hot days (35°C+)": """date IN (SELECT date FROM compared_t WHERE temperature >= 35)""",
    "Rainy hours (1 mm+)": "precipitation_mm >= 1",
}
oracle(
    "score_slices",
    " UNION ALL ".join(
        f"SELECT '{name}' AS slice, {_SLICE} FROM compared_t WHERE {rule} HAVING count(*) > 0"
        for name, rule in _SLICES.items()
    ),
)


def _signed(change: str) -> str:
    return f"""printf('%+.0f%%', {change} * 100)"""


oracle(
    "worst_baseline_days",
    f"""WITH d AS (SELECT date, sum(count) / sum(baseline) - 1 AS change,
                          sum(abs(baseline - count)) / nullif(sum(count), 0) AS wape
                   FROM baseline_t WHERE baseline IS NOT NULL GROUP BY date),
             w AS (SELECT date, max(temperature) AS max_temp, sum(precipitation_mm) AS rain_mm
                   FROM order_view_t GROUP BY date)
        SELECT date, strftime(date, '%A') AS weekday, {r6('change')},
               {_signed('change')} AS actual_vs_baseline, {r6_all('wape', 'max_temp', 'rain_mm')},
               holiday_name
        FROM d JOIN w USING (date) JOIN calendar_t c USING (date)
        ORDER BY d.wape DESC NULLS LAST, date LIMIT 12""",
)
oracle(
    "worst_model_days",
    f"""WITH d AS (SELECT date, sum(count) AS actual, sum(model) / sum(count) - 1 AS change,
                          round(sum(abs(model - count)) / sum(count), 2) AS model_wape,
                          round(sum(abs(baseline - count)) / sum(count), 2) AS baseline_wape,
                          max(temperature) AS max_temp, max(precipitation_mm) AS max_rain_mm
                   FROM compared_t GROUP BY date HAVING sum(count) > 300)
        SELECT date, {r6('change')}, {_signed('change')} AS model_vs_actual, model_wape,
               baseline_wape, max_temp, max_rain_mm, holiday_name
        FROM d LEFT JOIN calendar_t USING (date)
        ORDER BY model_wape DESC NULLS LAST, date LIMIT 10""",
)
oracle(
    "sensor_week",
    f"""SELECT sensor_id, date, hour, count, {r6('baseline')}, baseline_weeks,
               CAST(date AS TIMESTAMP) + to_hours(CAST(hour AS BIGINT)) AS ts
        FROM baseline_t
        WHERE sensor_id = 0 AND date BETWEEN DATE '2000-01-24' AND DATE '2000-01-30'""",
)

# --- then and now ----------------------------------------------------------------

STEPS["sensor_day_t"] = (
    "SELECT sensor_id, date, "
    + ", ".join(
        f"CAST(sum(count) FILTER (WHERE hour BETWEEN {a} AND {b}) AS BIGINT) AS {w}"
        for w, (a, b) in WINDOWS.items()
    )
    + """, period, strftime(date, '%a') AS dow, CAST(month(date) AS INTEGER) AS month,
           strftime(date, '%G-%V') AS week
    FROM scoped_t s JOIN calendar_t c USING (date)
    WHERE NOT c.is_holiday
      AND NOT EXISTS (SELECT 1 FROM fault_t f WHERE f.sensor_id = s.sensor_id AND f.date = s.date)
    GROUP BY sensor_id, date, period HAVING count(*) = 4"""
)
oracle("sensor_days", "SELECT * FROM sensor_day_t")
oracle("stored_sensor_days", "SELECT * FROM sensor_day_t")
oracle("period_counts", "SELECT period, count(*) AS sensor_days FROM sensor_day_t GROUP BY period")
STEPS["kind_t"] = """
    SELECT sensor_id, weekday_vs_weekend,
           CASE WHEN weekday_vs_weekend >= 1.0 THEN 'office' ELSE 'retail/leisure' END AS type
    FROM (SELECT sensor_id, avg(daily) FILTER (WHERE dow NOT IN ('Sat', 'Sun'))
                 / avg(daily) FILTER (WHERE dow IN ('Sat', 'Sun')) AS weekday_vs_weekend
          FROM sensor_day_t WHERE period = '1996' GROUP BY sensor_id)"""
oracle("classify_sensors", f"SELECT sensor_id, type, {r6('weekday_vs_weekend')} FROM kind_t")
STEPS["obs_t"] = " UNION ALL ".join(
    f"SELECT '{w}' AS fit, *, ln({w}) AS y FROM sensor_day_t WHERE {w} > 0"
    for w in ("daily", "am_peak", "evening")
)
_DAY_POSITION = "CASE dow " + " ".join(
    f"WHEN '{d}' THEN {i}" for i, d in enumerate(OTHER_DAYS)
) + " END"


def _regression_steps(tag: str, obs: str) -> None:
    """Steps of the within-sensor normal equations for observations ``obs``."""
    STEPS[f"{tag}term_t"] = f"""
        SELECT fit, sensor_id, date, week, y, unnest(list_filter([
            CASE WHEN month > 1 THEN month - 2 END, 11 + {_DAY_POSITION},
            CASE WHEN period = 'recent' THEN 17 END,
            CASE WHEN period = 'recent' THEN 18 + {_DAY_POSITION} END],
            lambda x: x IS NOT NULL)) AS i
        FROM {obs}"""
    STEPS[f"{tag}mean_t"] = f"""
        SELECT fit, sensor_id, count(*) AS n, sum(y) AS sy FROM {obs} GROUP BY ALL"""
    STEPS[f"{tag}sz_t"] = f"""
        SELECT fit, sensor_id, i, count(*) AS sz FROM {tag}term_t GROUP BY ALL"""
    STEPS[f"{tag}gram_t"] = f"""
        SELECT fit, i, j, sum(x) AS x FROM (
            SELECT a.fit, a.i, b.i AS j, CAST(1 AS DOUBLE) AS x
            FROM {tag}term_t a JOIN {tag}term_t b
              ON b.fit = a.fit AND b.sensor_id = a.sensor_id AND b.date = a.date AND b.i >= a.i
            UNION ALL
            SELECT a.fit, a.i, b.i, -CAST(a.sz AS DOUBLE) * b.sz / m.n
            FROM {tag}sz_t a JOIN {tag}sz_t b
              ON b.fit = a.fit AND b.sensor_id = a.sensor_id AND b.i >= a.i
            JOIN {tag}mean_t m ON m.fit = a.fit AND m.sensor_id = a.sensor_id
            UNION ALL
            SELECT fit, i, 24, y FROM {tag}term_t
            UNION ALL
            SELECT a.fit, a.i, 24, -a.sz * m.sy / m.n
            FROM {tag}sz_t a JOIN {tag}mean_t m ON m.fit = a.fit AND m.sensor_id = a.sensor_id)
        GROUP BY fit, i, j"""


_regression_steps("window_", "obs_t")
oracle(
    "normal_equations",
    f"""SELECT fit, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r6('x')}
        FROM window_gram_t WHERE abs(x) > 1e-7""",
)
oracle(
    "recovery_sizes",
    """SELECT fit, count(*) AS rows, count(DISTINCT sensor_id) AS sensors,
              count(DISTINCT week) AS weeks,
              count(DISTINCT sensor_id) + count(DISTINCT month) - 1 + count(DISTINCT dow) - 1
                  + count(DISTINCT dow) * (count(DISTINCT period) - 1) AS columns
       FROM obs_t GROUP BY fit""",
)
oracle(
    "weekday_recovery_saturated",
    f"""SELECT dow, {r6("exp(avg(ln(daily)) FILTER (WHERE period = 'recent') - avg(ln(daily)) FILTER (WHERE period = '1996'))", 'ratio')},
               count(*) AS sensor_days
        FROM sensor_day_t WHERE daily > 0 GROUP BY dow""",
)

# The full regression: eliminate the 24 x 24 system step by step, then sum the
# weekly scores of each contrast.
STEPS["study_t"] = """
    SELECT d.*, coalesce(k.type, 'retail/leisure') AS type,
           coalesce(p.note LIKE '%Pushbox%', false) AS upgraded
    FROM sensor_day_t d LEFT JOIN kind_t k USING (sensor_id) LEFT JOIN place_t p USING (sensor_id)"""
DAY_GROUPS = {
    "Mon + Fri": {"Mon": "0.5", "Fri": "0.5"},
    "Tue–Thu": {"Tue": "1 / 3.0", "Wed": "1 / 3.0", "Thu": "1 / 3.0"},
    "Weekend": {"Sat": "0.5", "Sun": "0.5"},
}
GAP = {"gap": {"Mon": "0.5", "Fri": "0.5", "Tue": "-1 / 3.0", "Wed": "-1 / 3.0", "Thu": "-1 / 3.0"}}
DAYS = {d: {d: "1"} for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")}


def _weights(contrasts: dict[str, dict[str, str]]) -> str:
    rows = []
    for name, days in contrasts.items():
        rows.append(f"('{name}', 17, CAST({' + '.join(f'({w})' for w in days.values())} AS DOUBLE))")
        rows += [
            f"('{name}', {18 + OTHER_DAYS.index(d)}, CAST({w} AS DOUBLE))"
            for d, w in days.items()
            if d != "Wed"
        ]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(contrast, i, w)"


def _recovery_steps(tag: str, obs: str, contrasts: dict[str, dict[str, str]]) -> str:
    """Steps ending in a table (fit, contrast, estimate, se, z, sensors)."""
    STEPS[f"{tag}_obs_t"] = obs
    _regression_steps(f"{tag}_", f"{tag}_obs_t")
    STEPS[f"{tag}_cell_t"] = f"""
        SELECT f.fit, r.i, c.j,
               CASE WHEN c.j > 24 AND c.j < 49 THEN CASE WHEN c.j - 25 = r.i THEN 1.0 ELSE 0.0 END
                    ELSE coalesce(g.x, 0.0) END::DOUBLE AS x
        FROM (SELECT DISTINCT fit FROM {tag}_gram_t) f,
             (SELECT unnest(range(24)) AS i) r, (SELECT unnest(range(50)) AS j) c
        LEFT JOIN {tag}_gram_t g ON g.fit = f.fit AND g.i = CASE WHEN c.j = 49 THEN r.i ELSE least(r.i, c.j) END
            AND g.j = CASE WHEN c.j = 49 THEN 24 ELSE greatest(r.i, c.j) END
        WHERE c.j <> 24"""
    STEPS[f"{tag}_matrix_t"] = f"""
        SELECT fit, list(line ORDER BY i) AS m
        FROM (SELECT fit, i, list(x ORDER BY j) AS line FROM {tag}_cell_t GROUP BY fit, i)
        GROUP BY fit"""
    STEPS[f"{tag}_solve_t"] = f"""
        SELECT fit, 1 AS k, m FROM {tag}_matrix_t
        UNION ALL
        SELECT fit, k + 1, list_transform(range(1, 25), lambda r:
                   CASE WHEN r = k THEN list_transform(m[r], lambda v: v / m[k][k])
                        ELSE list_transform(range(1, 50), lambda c:
                            m[r][c] - m[r][k] * m[k][c] / m[k][k]) END)
        FROM {tag}_solve_t WHERE k <= 24"""
    STEPS[f"{tag}_beta_t"] = f"""
        SELECT fit, i, m[i + 1][49] AS beta, m[i + 1][25:48] AS inverse
        FROM {tag}_solve_t, (SELECT unnest(range(24)) AS i) WHERE k = 25"""
    STEPS[f"{tag}_shift_t"] = f"""
        SELECT s.fit, s.sensor_id, sum(s.sz * b.beta) / any_value(m.n) AS shift
        FROM {tag}_sz_t s JOIN {tag}_beta_t b ON b.fit = s.fit AND b.i = s.i
        JOIN {tag}_mean_t m ON m.fit = s.fit AND m.sensor_id = s.sensor_id
        GROUP BY s.fit, s.sensor_id"""
    STEPS[f"{tag}_resid_t"] = f"""
        SELECT o.fit, o.sensor_id, o.date, o.week,
               o.y - any_value(m.sy / m.n) + coalesce(any_value(h.shift), 0)
                   - coalesce(sum(b.beta), 0) AS u
        FROM {tag}_obs_t o
        JOIN {tag}_mean_t m ON m.fit = o.fit AND m.sensor_id = o.sensor_id
        LEFT JOIN {tag}_shift_t h ON h.fit = o.fit AND h.sensor_id = o.sensor_id
        LEFT JOIN {tag}_term_t t ON t.fit = o.fit AND t.sensor_id = o.sensor_id AND t.date = o.date
        LEFT JOIN {tag}_beta_t b ON b.fit = t.fit AND b.i = t.i
        GROUP BY o.fit, o.sensor_id, o.date, o.week, o.y"""
    STEPS[f"{tag}_score_t"] = f"""
        SELECT fit, week, i, sum(x) AS x FROM (
            SELECT t.fit, t.week, t.i, r.u AS x
            FROM {tag}_term_t t JOIN {tag}_resid_t r
              ON r.fit = t.fit AND r.sensor_id = t.sensor_id AND r.date = t.date
            UNION ALL
            SELECT r.fit, r.week, s.i, -r.u * s.sz / m.n
            FROM {tag}_resid_t r
            JOIN {tag}_sz_t s ON s.fit = r.fit AND s.sensor_id = r.sensor_id
            JOIN {tag}_mean_t m ON m.fit = r.fit AND m.sensor_id = r.sensor_id)
        GROUP BY fit, week, i"""
    STEPS[f"{tag}_weight_t"] = _weights(contrasts)
    STEPS[f"{tag}_lever_t"] = f"""
        SELECT b.fit, w.contrast, b.i, sum(b.inverse[w.i + 1] * w.w) AS a
        FROM {tag}_beta_t b, {tag}_weight_t w GROUP BY ALL"""
    STEPS[f"{tag}_spread_t"] = f"""
        SELECT fit, contrast, sum(t * t) AS variance
        FROM (SELECT s.fit, l.contrast, s.week, sum(l.a * s.x) AS t
              FROM {tag}_score_t s JOIN {tag}_lever_t l ON l.fit = s.fit AND l.i = s.i
              GROUP BY ALL)
        GROUP BY fit, contrast"""
    STEPS[f"{tag}_size_t"] = f"""
        SELECT fit, count(*) AS n, count(DISTINCT sensor_id) AS sensors, count(DISTINCT week) AS g,
               count(DISTINCT sensor_id) + 11 + 6 + 7 AS p
        FROM {tag}_obs_t GROUP BY fit"""
    STEPS[f"{tag}_contrast_t"] = f"""
        SELECT e.fit, e.contrast, e.estimate, z.sensors,
               sqrt(s.variance * z.g / (z.g - 1) * (z.n - 1) / (z.n - z.p)) AS se
        FROM (SELECT b.fit, w.contrast, sum(b.beta * w.w) AS estimate
              FROM {tag}_beta_t b JOIN {tag}_weight_t w ON w.i = b.i GROUP BY ALL) e
        JOIN {tag}_spread_t s ON s.fit = e.fit AND s.contrast = e.contrast
        JOIN {tag}_size_t z ON z.fit = e.fit"""
    return f"{tag}_contrast_t"


def _observed(fits: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS fit, *, ln({window}) AS y FROM study_t WHERE {window} > 0 AND {rule}"
        for name, (window, rule) in fits.items()
    )


_RATIOS = f"""{r6('exp(estimate)', 'ratio')}, {r6('exp(estimate - 1.96 * se)', 'low')},
    {r6('exp(estimate + 1.96 * se)', 'high')}, sensors"""
# two-sided normal tail by Simpson's rule on [0, |z|]
_TAIL = """1 - 2 * (SELECT sum(exp(-0.5 * (h * estimate / se) * (h * estimate / se)) * weight)
                     * abs(estimate / se) / 6000 / sqrt(2 * pi())
                FROM (SELECT k / 2000.0::DOUBLE AS h,
                             CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS weight
                      FROM range(2001) g(k)))"""
_GAP = f"""{r6('exp(estimate) - 1', 'gap')}, {r6('exp(estimate - 1.96 * se) - 1', 'low')},
    {r6('exp(estimate + 1.96 * se) - 1', 'high')}, {r6(_TAIL, 'p')}"""
_KINDS = {"Office district": "office", "Retail / leisure": "retail/leisure"}
_KIND_FITS = lambda windows: {
    f"{name}|{w}": (w, f"type = '{kind}'") for name, kind in _KINDS.items() for w in windows
}

_all = _recovery_steps("every", _observed({"All": ("daily", "true")}), DAYS)
oracle("weekday_recovery", f"SELECT contrast AS day, {_RATIOS} FROM {_all}")
_types = _recovery_steps(
    "kinds", _observed({n: ("daily", f"type = '{k}'") for n, k in _KINDS.items()}), DAYS
)
oracle(
    "weekday_recovery_by_type",
    f'SELECT fit AS "group", contrast AS day, {_RATIOS} FROM {_types}',
)
_NAMES = """split_part(fit, '|', 1) AS "group", split_part(fit, '|', 2) AS "window" """
_hours = _recovery_steps(
    "hours", _observed(_KIND_FITS(("am_peak", "lunch", "pm_peak", "evening"))), DAY_GROUPS
)
oracle("recovery_by_window", f"SELECT {_NAMES}, contrast AS days, {_RATIOS} FROM {_hours}")
_gaps = _recovery_steps("gaps", _observed(_KIND_FITS(("daily", "am_peak", "evening"))), GAP)
oracle("gap_by_window", f"SELECT {_NAMES}, {_GAP}, sensors FROM {_gaps}")
_SAMPLES = {
    "All office sensors": "true",
    "Only upgraded sensors": "upgraded",
    "Only sensors not upgraded": "NOT upgraded",
    "First recent year": "(period = '1996' OR date < DATE '2000-01-01')",
    "Second recent year": "(period = '1996' OR date >= DATE '2000-01-01')",
}
_checks = _recovery_steps(
    "checks",
    _observed(
        {
            f"{name}|{w}": (w, f"type = 'office' AND {rule}")
            for name, rule in _SAMPLES.items()
            for w in ("daily", "am_peak")
        }
    ),
    {**DAY_GROUPS, **GAP},
)


def _picked(window: str, contrast: str, expr: str, name: str) -> str:
    rule = f"split_part(fit, '|', 2) = '{window}' AND contrast = '{contrast}'"
    return r6(f"max({expr}) FILTER (WHERE {rule})", name)


oracle(
    "robustness",
    f"""SELECT split_part(fit, '|', 1) AS sample,
               {_picked('daily', 'Mon + Fri', 'exp(estimate)', 'mon_fri_vs_base')},
               {_picked('daily', 'Tue–Thu', 'exp(estimate)', 'tue_thu_vs_base')},
               {_picked('daily', 'Weekend', 'exp(estimate)', 'weekend_vs_base')},
               {_picked('am_peak', 'gap', 'exp(estimate) - 1', 'morning_gap')},
               max(sensors) FILTER (WHERE split_part(fit, '|', 2) = 'daily') AS sensors
        FROM {_checks} GROUP BY 1""",
)
_single = _recovery_steps(
    "single",
    "SELECT CAST(sensor_id AS VARCHAR) AS fit, *, ln(am_peak) AS y FROM study_t WHERE am_peak > 0",
    GAP,
)
oracle(
    "per_sensor_gap",
    f"""SELECT CAST(fit AS INTEGER) AS sensor_id, {_GAP}, type
        FROM {_single} JOIN (SELECT DISTINCT CAST(sensor_id AS VARCHAR) AS fit, type FROM study_t)
        USING (fit)""",
)
oracle(
    "gap_share",
    f"SELECT count(*) FILTER (WHERE estimate < 0) AS with_gap, count(*) AS sensors FROM {_single}",
)
