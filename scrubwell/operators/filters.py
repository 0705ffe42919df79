"""Row masks that drop a trailing period which the data don't fill."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import quoted_name

__all__ = "PeriodInterval within_complete_month within_complete_period".split()

type PeriodInterval = Literal["1d", "1w", "1mo", "1q", "1y"]
_UNITS = {"1d": ("day", "INTERVAL 1 DAY"), "1w": ("week", "INTERVAL 7 DAYS"), "1mo": ("month", "INTERVAL 1 MONTH"), "1q": ("quarter", "INTERVAL 3 MONTHS"), "1y": ("year", "INTERVAL 1 YEAR")}


def within_complete_period(df: DataFrame, column: str, period: PeriodInterval, threshold_days: int) -> Column:
    """A mask for ``df.filter``: false in the period of the latest value if more than ``threshold_days`` whole days
    of it are still to come after that value. Keeps everything where there is no value at all."""
    unit, length = _UNITS[period]
    c = F.col(quoted_name(column)).cast("timestamp_ntz")
    start = lambda x: F.date_trunc(unit, x).cast("timestamp_ntz")
    latest = df.select(F.max(c)).scalar()
    end = start(latest) + F.expr(length) - F.expr("INTERVAL 1 DAY")
    open_ = F.timestamp_diff("DAY", latest, end) > threshold_days
    return F.when(open_, start(c) != start(latest)).otherwise(F.lit(True))


def within_complete_month(df: DataFrame, column: str, threshold_days: int = 5) -> Column:
    return within_complete_period(df, column, "1mo", threshold_days)
