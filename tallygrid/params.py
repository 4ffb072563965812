"""One frozen object with everything a query can be tuned by."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date

from . import fixed


@dataclass(frozen=True)
class Params:
    """Sensors, periods, lags and thresholds; the defaults are the study's own.

    ``sensors=None`` means every sensor in the table.
    """

    sensors: tuple[int, ...] | None = fixed.STUDY_SENSORS
    moved_sensors: tuple[int, ...] = fixed.MOVED_SENSORS
    latitudes: tuple[float, float] = fixed.STUDY_LATITUDES
    longitudes: tuple[float, float] = fixed.STUDY_LONGITUDES
    min_coverage: float = fixed.MIN_COVERAGE
    upgrade_word: str = fixed.UPGRADE_WORD

    base_year: int = fixed.BASE_YEAR
    base_hours: int = fixed.BASE_YEAR_HOURS
    recent_start: date = fixed.RECENT_START
    recent_end: date = fixed.RECENT_END
    recent_hours: int = fixed.RECENT_HOURS

    slots_per_day: int = fixed.SLOTS_PER_DAY
    # the hours of a whole day; None: 0 up to slots_per_day
    hours: tuple[int, ...] | None = None
    daytime_hours: tuple[int, int] = fixed.DAYTIME_HOURS
    fault_min_rows: int = fixed.FAULT_MIN_ROWS
    smooth_days: int = fixed.SMOOTH_DAYS
    smooth_min_days: int = fixed.SMOOTH_MIN_DAYS

    min_lag: int = fixed.MIN_LAG_DAYS
    baseline_lags: tuple[int, ...] = fixed.BASELINE_LAGS
    single_lags: tuple[int, ...] = fixed.SINGLE_LAGS
    year_lag: int = fixed.YEAR_LAG
    season_years: tuple[int, int] = (fixed.SEASON_FIRST_YEAR, fixed.SEASON_LAST_YEAR)
    event_names: tuple[str, ...] = fixed.EVENT_NAMES

    windows: Mapping[str, tuple[int, int]] = field(
        default_factory=lambda: dict(fixed.HOUR_WINDOWS)
    )
    office_ratio: float = fixed.OFFICE_RATIO
    time_zone: str = fixed.LOCAL_TIME_ZONE

    def __post_init__(self) -> None:
        # A forecast may only see counts that are published by the target day.
        too_fresh = [lag for lag in self.all_lags if lag < self.min_lag]
        if too_fresh:
            raise ValueError(
                f"lags {too_fresh} would use counts newer than {self.min_lag} days"
            )
        if len(self.day_hours) != self.slots_per_day:
            raise ValueError(f"{self.slots_per_day} slots a day, but hours {self.day_hours}")
        if self.recent_end < self.recent_start:
            raise ValueError("the recent period ends before it starts")

    @property
    def base_label(self) -> str:
        return str(self.base_year)

    @property
    def base_start(self) -> date:
        return date(self.base_year, 1, 1)

    @property
    def base_end(self) -> date:
        return date(self.base_year, 12, 31)

    @property
    def day_hours(self) -> tuple[int, ...]:
        return tuple(range(self.slots_per_day)) if self.hours is None else self.hours

    @property
    def all_lags(self) -> tuple[int, ...]:
        return tuple(sorted({*self.baseline_lags, *self.single_lags, self.year_lag}))

    def with_(self, **changes) -> Params:
        return replace(self, **changes)
