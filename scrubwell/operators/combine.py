"""Several columns into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubwell.functions.columns import quoted_name
from scrubwell.functions.text import nullify_blank_strings

__all__ = "coalesce_blank_columns combine_columns hash_key".split()


def _columns(columns: Sequence[str]) -> list[Column]:
    if not columns:
        raise ValueError("columns must not be empty")
    return [F.col(quoted_name(c)) for c in columns]


def combine_columns(columns: Sequence[str], output: str, separator: str = " ") -> Column:
    """Joined as strings, nulls skipped; all null gives an empty string."""
    return F.concat_ws(separator, *[c.cast("string") for c in _columns(columns)]).alias(output)


def coalesce_blank_columns(columns: Sequence[str], output: str) -> Column:
    """The first that is neither null nor blank, as it is."""
    return F.coalesce(*[nullify_blank_strings(c) for c in _columns(columns)]).alias(output)


def hash_key(columns: Sequence[str], output: str) -> Column:
    """A 64-bit key of the tuple of values, signed. Null counts as a value, and positions matter
    (Spark's hash alone passes over nulls)."""
    return F.xxhash64(*[x for c in _columns(columns) for x in (c.isNull(), c)]).alias(output)
