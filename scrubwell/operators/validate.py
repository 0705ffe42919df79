"""Guards: nothing, or ``ValueError``. One aggregate; examples are fetched only on failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubwell.functions.columns import quoted_name

__all__ = "assert_no_nulls assert_string_length".split()

EXAMPLES = 5
type Bound = int | None


def assert_no_nulls(df: DataFrame, column: str) -> None:
    n = df.select(F.count_if(F.col(quoted_name(column)).isNull())).first()[0]
    if n:
        raise ValueError(f"column {column!r} contains {n} null value(s)")


def length_violation(df: DataFrame, column: str, min_length: Bound, max_length: Bound, ignore_null: bool) -> Column:
    """True where a value is too short or too long, or null unless those are ignored."""
    if min_length is None and max_length is None:
        raise ValueError("give min_length, max_length or both")
    c = F.col(quoted_name(column))
    if not isinstance(df.select(c).schema[0].dataType, T.StringType):
        raise TypeError(f"column {column!r} is not a string column")
    bad = F.lit(False)
    if min_length is not None:
        bad = bad | (F.length(c) < min_length)
    if max_length is not None:
        bad = bad | (F.length(c) > max_length)
    return F.coalesce(bad, F.lit(False)) if ignore_null else F.coalesce(bad, F.lit(True))


def assert_string_length(
    df: DataFrame, column: str, *, min_length: Bound = None, max_length: Bound = None, ignore_null: bool = False
) -> None:
    bad = length_violation(df, column, min_length, max_length, ignore_null)
    n = df.select(F.count_if(bad)).first()[0]
    if n:
        shown = [r[0] for r in df.filter(bad).select(F.col(quoted_name(column))).limit(EXAMPLES).collect()]
        raise ValueError(f"column {column!r} has {n} value(s) of a length outside {min_length}..{max_length}, e.g. {shown}")
