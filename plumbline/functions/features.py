"""Derived features: named functions from columns to columns."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours of the night, and of the morning and evening rush.
NIGHT_HOURS = (0, 1, 2, 3, 4, 5, 21, 22, 23)
RUSH_HOURS = (7, 8, 9, 17, 18, 19)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("long")


def hour(c: str) -> Column:
    return F.hour(c).cast("long")


def weekday(c: str) -> Column:
    """Monday is 0."""
    return F.weekday(c).cast("long")


def month(c: str) -> Column:
    return F.month(c).cast("long")


def is_weekend(c: str) -> Column:
    return _flag(F.weekday(c).isin(5, 6))


def is_night(c: str) -> Column:
    return _flag(F.hour(c).isin(*NIGHT_HOURS))


def in_hours(c: str, hours=RUSH_HOURS) -> Column:
    return _flag(F.hour(c).isin(*hours))


def log1p(c: str) -> Column:
    """Null for -1 and below."""
    return F.when(F.col(c) > -1, F.log1p(c))


def same_group(a: str, b: str) -> Column:
    """1 if equal; a null equals nothing."""
    return _flag(F.col(a) == F.col(b))


def rate_per_hour(amount: str, minutes: str) -> Column:
    """Null where no time passed."""
    return F.try_divide(F.col(amount).cast("double"), F.col(minutes) / 60)


def duration_minutes(start: str, end: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(60_000_000.0)


def time_bucket(c: str, ranges: Mapping[str, tuple[int, int]], default: str) -> Column:
    """The first range whose start <= hour < end."""
    out = None
    for name, (start, end) in ranges.items():
        test = (F.hour(c) >= start) & (F.hour(c) < end)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else out.otherwise(default)


def copy(c: str) -> Column:
    return F.col(c)


BUILDERS: dict[str, Callable[..., Column]] = {
    "hour": hour,
    "weekday": weekday,
    "month": month,
    "is_weekend": is_weekend,
    "is_night": is_night,
    "in_hour_window": in_hours,
    "log1p": log1p,
    "same_group": same_group,
    "rate_per_hour": rate_per_hour,
    "duration_minutes": duration_minutes,
    "copy": copy,
}


def register_builder(name: str, build: Callable[..., Column], registry: dict | None = None) -> None:
    """Add a builder; a name that is taken is an error. A pandas UDF may be what it returns."""
    registry = BUILDERS if registry is None else registry
    if name in registry:
        raise ValueError(f"builder {name} exists")
    registry[name] = build


def load_builders(module: str, registry: dict | None = None) -> None:
    """Register all of a module's BUILDERS."""
    found = getattr(importlib.import_module(module), "BUILDERS", None)
    if not isinstance(found, dict):
        raise ValueError(f"{module} has no BUILDERS")
    for name, build in found.items():
        register_builder(name, build, registry)


def build_derived(df: DataFrame, features: list[tuple[str, str, tuple[str, ...]]], registry: dict | None = None) -> DataFrame:
    """Add (name, function, source columns) features, all from the columns of ``df``."""
    registry = BUILDERS if registry is None else registry
    for _, function, sources in features:
        if function not in registry:
            raise ValueError(f"unknown function {function}")
        missing = [c for c in sources if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({name: registry[function](*sources) for name, function, sources in features})
