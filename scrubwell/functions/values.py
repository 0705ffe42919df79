"""Missing values, padding and splitting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubwell.functions.patterns import quoted
from scrubwell.functions.tables import DEFAULT_SPLIT_DELIMITERS
from scrubwell.functions.text import strip_whitespace
from scrubwell.types import ColumnTransform

__all__ = "nullify_sentinels pad_left split_on_delimiters".split()


def nullify_sentinels(sentinels: Iterable[str], *, case_insensitive: bool = True) -> ColumnTransform:
    """Null where the stripped value is a sentinel; other values come back untouched."""
    sentinels = set(sentinels)
    if not sentinels:
        raise ValueError("sentinels must not be empty")
    known = sorted({s.strip().upper() if case_insensitive else s.strip() for s in sentinels})

    def transform(c: Column) -> Column:
        bare = strip_whitespace(c)
        return F.when((F.upper(bare) if case_insensitive else bare).isin(known), F.lit(None)).otherwise(c)

    return transform


def pad_left(width: int, *, fill: str = "0") -> ColumnTransform:
    """At least ``width`` signs; longer values stay whole."""
    if width < 1:
        raise ValueError("width must be at least 1")
    if len(fill) != 1:
        raise ValueError("fill must be one character")
    return lambda c: F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def split_on_delimiters(delimiters: Iterable[str] = DEFAULT_SPLIT_DELIMITERS, *, dedup_delimiters: bool = False) -> ColumnTransform:
    """An array of stripped tokens; a blank token is a null element. With ``dedup_delimiters`` a run of delimiters cuts once."""
    delimiters = list(delimiters)
    if not delimiters:
        raise ValueError("delimiters must not be empty")
    if any(len(d) != 1 for d in delimiters):
        raise ValueError("each delimiter must be one character")
    pattern = "[" + "".join(quoted(d) for d in dict.fromkeys(delimiters)) + "]" + "+" * dedup_delimiters
    return lambda c: F.transform(F.split(c, pattern, -1), lambda t: F.nullif(strip_whitespace(t), F.lit("")))
