"""Epochs, spreadsheet dates and date ranges; timestamps have no zone."""

from __future__ import annotations

from datetime import date, datetime
from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubwell.types import ColumnTransform

__all__ = "EpochTimeUnit flag_dates_outside_range normalize_epoch_timestamps normalize_excel_serial_dates".split()

type EpochTimeUnit = Literal["s", "ms", "us"]
_UNITS = {"s": "SECOND", "ms": "MILLISECOND", "us": "MICROSECOND"}


def _after(start: str, unit: str, amount: Column) -> Column:
    return F.timestamp_add(unit, amount, F.lit(start).cast("timestamp_ntz"))


def normalize_epoch_timestamps(unit: EpochTimeUnit) -> ColumnTransform:
    """Whole units since 1970 to a timestamp."""
    return lambda c: _after("1970-01-01 00:00:00", _UNITS[unit], c.cast("long"))


def normalize_excel_serial_dates(c: Column) -> Column:
    """Days since 1899-12-30, fractions allowed, to a timestamp of microseconds."""
    return _after("1899-12-30 00:00:00", "MICROSECOND", F.round(c.cast("double") * F.lit(86_400_000_000.0)).cast("long"))


def literal(value: date | datetime) -> Column:
    """A naive datetime as a timestamp without zone; ``lit`` alone would give one with the session's."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def flag_dates_outside_range(lower: date | datetime | None = None, upper: date | datetime | None = None) -> ColumnTransform:
    """True outside the inclusive bounds, null for null."""
    if lower is None and upper is None:
        raise ValueError("give lower, upper or both")

    def transform(c: Column) -> Column:
        tests = ([c < literal(lower)] if lower is not None else []) + ([c > literal(upper)] if upper is not None else [])
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]

    return transform
