"""Names, dates, formats and thresholds that decide the results.

Everything here is a published constant of the study (which sensors, which
periods, which hours), not logic. ``Params`` takes them as defaults.
"""

from datetime import date

# --- fixed values: sources and layouts -------------------------------------------
LOCAL_TIME_ZONE = "Australia/Melbourne"
ARCHIVE_SOURCE = "historic"
LIVE_SOURCE = "live"

PORTAL_COLUMNS = ("location_id", "sensing_date", "hourday", "pedestriancount")
ARCHIVE_COLUMNS = ("sensor_id", "date_time", "hourly_counts")
ARCHIVE_TIME_FORMATS = (
    "MMMM d, yyyy h:mm:ss a",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "d/M/yyyy h:mm:ss a",
)
MAX_BAD_SHARE = 0.01
BAD_SAMPLE_ROWS = 5

# hourly weather variable -> column of the local-hour weather view
WEATHER_VIEW_COLUMNS = {
    "temperature_2m": "temperature",
    "apparent_temperature": "apparent_temperature",
    "precipitation": "precipitation_mm",
    "rain": "rain_mm",
    "relative_humidity_2m": "humidity",
    "cloud_cover": "cloud_cover",
    "wind_speed_10m": "wind_speed",
}
# amounts that add up when a local hour occurs twice; the others are averaged
SUMMED_WEATHER = ("precipitation", "rain")

# --- fixed values: refresh windows -----------------------------------------------
LIVE_OVERLAP_DAYS = 14
WEATHER_OVERLAP_DAYS = 2
WEATHER_LAG_DAYS = 7
WEATHER_FIRST_DAY = date(2009, 5, 1)
CALENDAR_FIRST_DAY = date(2009, 1, 1)
CALENDAR_DAYS_AHEAD = 90

# --- fixed values: sensors and periods of the study ------------------------------
STUDY_SENSORS = (2, 3, 4, 5, 17, 18, 19, 20, 21, 23, 24, 30, 36, 40, 52, 53, 56, 58)
MOVED_SENSORS = (6, 47)
STUDY_LATITUDES = (-37.8200, -37.8090)
STUDY_LONGITUDES = (144.9520, 144.9745)
MIN_COVERAGE = 0.9
BASE_YEAR = 2019
BASE_YEAR_HOURS = 8760
RECENT_START = date(2024, 10, 1)
RECENT_END = date(2026, 9, 30)
RECENT_HOURS = 730 * 24
GRID_FIRST_MONTH = date(2009, 5, 1)
GRID_LAST_MONTH = date(2026, 9, 1)
UPGRADE_WORD = "Pushbox"

# --- fixed values: day shape -----------------------------------------------------
SLOTS_PER_DAY = 24
DAYTIME_HOURS = (8, 20)
FAULT_MIN_ROWS = 10
SMOOTH_DAYS = 28
SMOOTH_MIN_DAYS = 20
DAY_TYPES = ("Monday", "Tue–Thu", "Friday", "Weekend")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
REFERENCE_WEEKDAY = "Wed"

# upper edges of right-closed classes; the first lower edge is exclusive
RAIN_EDGES = (-0.01, 0.0, 1.0, 3.0, 100.0)
RAIN_LABELS = ("Dry", "0–1 mm", "1–3 mm", "3+ mm")
TEMPERATURE_EDGES = (-5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 50.0)
TEMPERATURE_LABELS = ("<10°", "10–15°", "15–20°", "20–25°", "25–30°", "30–35°", "35°+")

# --- fixed values: forecast features ---------------------------------------------
MIN_LAG_DAYS = 35
BASELINE_LAGS = (35, 42, 49, 56)
SINGLE_LAGS = (35, 42)
YEAR_LAG = 364
SEASON_FIRST_YEAR = 2014
SEASON_LAST_YEAR = 2019
SEASON_SMOOTH_DAYS = 7
TYPICAL_WEATHER_DAYS = 3
SUPPLIED_WEATHER_MIN_HOURS = 20
EVENT_NAMES = (
    "australian_open",
    "grand_prix",
    "moomba",
    "lunar_new_year",
    "afl_grand_final",
    "new_years_eve",
)
HOT_DAY_DEGREES = 35.0
RAINY_HOUR_MM = 1.0
WORST_BASELINE_DAYS = 12
WORST_MODEL_DAYS = 10
WORST_MODEL_MIN_TOTAL = 10000
TOP_IMPORTANCES = 15

# boosted trees
TREE_COUNT = 600
TREE_STEP = 0.05
TREE_DEPTH = 6  # 63 leaves
TREE_MIN_ROWS = 50
TREE_ROW_SHARE = 0.8
TREE_COLUMN_SHARE = 0.8
TREE_SEED = 42

# --- fixed values: then-vs-now regression ----------------------------------------
HOUR_WINDOWS = {
    "daily": (0, 23),
    "am_peak": (7, 9),
    "lunch": (12, 13),
    "pm_peak": (16, 18),
    "evening": (19, 23),
}
DAY_GROUPS = {
    "Mon + Fri": {"Mon": 0.5, "Fri": 0.5},
    "Tue–Thu": {"Tue": 1 / 3, "Wed": 1 / 3, "Thu": 1 / 3},
    "Weekend": {"Sat": 0.5, "Sun": 0.5},
}
OFFICE_RATIO = 1.3
OFFICE_CLASS = "office"
RETAIL_CLASS = "retail/leisure"
NORMAL_95 = 1.96

# --- fixed values: school terms and event days -----------------------------------
SCHOOL_TERMS = (
    # year, term, first day, last day
    (2024, 1, "2024-01-29", "2024-03-28"),
    (2024, 2, "2024-04-15", "2024-06-28"),
    (2024, 3, "2024-07-15", "2024-09-20"),
    (2024, 4, "2024-10-07", "2024-12-20"),
    (2025, 1, "2025-01-28", "2025-04-04"),
    (2025, 2, "2025-04-22", "2025-07-04"),
    (2025, 3, "2025-07-21", "2025-09-19"),
    (2025, 4, "2025-10-06", "2025-12-19"),
    (2026, 1, "2026-01-27", "2026-04-02"),
    (2026, 2, "2026-04-20", "2026-06-26"),
    (2026, 3, "2026-07-13", "2026-09-18"),
    (2026, 4, "2026-10-05", "2026-12-18"),
    (2027, 1, "2027-01-27", "2027-03-25"),
    (2027, 2, "2027-04-12", "2027-06-25"),
    (2027, 3, "2027-07-12", "2027-09-17"),
    (2027, 4, "2027-10-04", "2027-12-17"),
)
EVENT_DAYS = (
    # event, first day, last day
    ("australian_open", "2025-01-12", "2025-01-26"),
    ("australian_open", "2026-01-18", "2026-02-01"),
    ("grand_prix", "2025-03-14", "2025-03-16"),
    ("grand_prix", "2026-03-06", "2026-03-08"),
    ("moomba", "2025-03-07", "2025-03-10"),
    ("moomba", "2026-03-06", "2026-03-09"),
    ("lunar_new_year", "2025-01-29", "2025-01-29"),
    ("lunar_new_year", "2026-02-17", "2026-02-17"),
    ("afl_grand_final", "2024-09-28", "2024-09-28"),
    ("afl_grand_final", "2025-09-27", "2025-09-27"),
    ("afl_grand_final", "2026-09-26", "2026-09-26"),
    ("new_years_eve", "2024-12-31", "2024-12-31"),
    ("new_years_eve", "2025-12-31", "2025-12-31"),
    ("new_years_eve", "2026-12-31", "2026-12-31"),
)
