"""Project settings from TOML, checked by a table of rules."""

from __future__ import annotations

import datetime as dt
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Study area, time window, thresholds and display points of a project."""

    study_area: str
    bbox: tuple[float, float, float, float]
    years: tuple[int, ...]
    benchmarks: tuple[int, ...]
    month: int
    days: tuple[int, int]
    endpoint: str
    collection: str
    baseline: float
    change: float
    least_hectares: float
    connectivity: int
    resolution: float
    black: float
    white: float
    gamma: float

    def windows(self) -> list[tuple[str, str]]:
        """Half-open UTC windows [start, day after the last), one a year."""
        first, last = self.days
        one = dt.timedelta(days=1)
        return [(f"{dt.date(y, self.month, first)}T00:00:00Z", f"{dt.date(y, self.month, last) + one}T00:00:00Z") for y in self.years]


def _is_date(year: int, month: int, day: int) -> bool:
    try:
        dt.date(year, month, day)
    except ValueError:
        return False
    return True


def _box(s: Settings) -> bool:
    west, south, east, north = s.bbox
    return -180 <= west < east <= 180 and -90 <= south < north <= 90


RULES: tuple[tuple[str, Callable[[Settings], bool]], ...] = (
    ("project.study_area_id must not be empty", lambda s: bool(s.study_area)),
    ("aoi must be west < east and south < north in degrees", _box),
    ("temporal.analysis_years must be consecutive", lambda s: bool(s.years) and all(b - a == 1 for a, b in zip(s.years, s.years[1:]))),
    ("temporal.benchmark_years must be among the analysis years", lambda s: set(s.benchmarks) <= set(s.years)),
    ("temporal.month must be 1 to 12", lambda s: s.month in range(1, 13)),
    ("temporal window days must be ordered days of a month", lambda s: 1 <= s.days[0] <= s.days[1] <= 31),
    ("temporal window days must exist in every year", lambda s: all(_is_date(y, s.month, d) for y in s.years for d in s.days)),
    ("stac.endpoint and stac.collection must not be empty", lambda s: bool(s.endpoint and s.collection)),
    ("disturbance.baseline_nbr_min must be -1 to 1", lambda s: abs(s.baseline) <= 1),
    ("disturbance.dnbr_min must be -2 to 2", lambda s: abs(s.change) <= 2),
    ("disturbance.min_patch_ha must be positive", lambda s: s.least_hectares > 0),
    ("disturbance.connectivity must be 4 or 8", lambda s: s.connectivity in (4, 8)),
    ("visualization.resolution_m must be positive", lambda s: s.resolution > 0),
    ("visualization black point must be 0 or more and below the white point", lambda s: 0 <= s.black < s.white),
    ("visualization.rgb_gamma must be positive", lambda s: s.gamma > 0),
)


def parse(text: str) -> Settings:
    """Settings of a TOML text; ValueError names the first thing that is missing, of a wrong type or out of range."""
    raw = tomllib.loads(text)

    def get(section: str, key: str, kind):
        try:
            value = raw[section][key]
            if kind is list:
                if not isinstance(value, list) or not all(type(x) is int for x in value):
                    raise TypeError
                return tuple(value)
            return kind(value)
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"{section}.{key} is missing or of a wrong type") from e

    out = Settings(
        study_area=get("project", "study_area_id", str), bbox=tuple(get("aoi", k, float) for k in ("west", "south", "east", "north")), years=get("temporal", "analysis_years", list), benchmarks=get("temporal", "benchmark_years", list),
        month=get("temporal", "month", int), days=(get("temporal", "window_start_day", int), get("temporal", "window_end_day", int)), endpoint=get("stac", "endpoint", str), collection=get("stac", "collection", str),
        baseline=get("disturbance", "baseline_nbr_min", float), change=get("disturbance", "dnbr_min", float), least_hectares=get("disturbance", "min_patch_ha", float), connectivity=get("disturbance", "connectivity", int),
        resolution=get("visualization", "resolution_m", float), black=get("visualization", "rgb_black_point", float), white=get("visualization", "rgb_white_point", float), gamma=get("visualization", "rgb_gamma", float),
    )
    for message, holds in RULES:
        if not holds(out):
            raise ValueError(message)
    return out


def load(path: str | Path) -> Settings:
    return parse(Path(path).read_text("utf-8"))
