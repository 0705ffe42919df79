"""Numbers in strings, after US conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubwell.functions.patterns import GROUPING, IN_PARENTHESES, MINUS_LAST, NUMBER

__all__ = """
accounting_parens_to_negative cast_to_float64 percent_to_fraction remove_thousands_separators
trailing_minus_to_prefix
""".split()


def accounting_parens_to_negative(c: Column) -> Column:
    """``(12)`` becomes ``-12``."""
    return F.regexp_replace(c, IN_PARENTHESES, "-$1")


def trailing_minus_to_prefix(c: Column) -> Column:
    """``12-`` becomes ``-12``; needs two signs before the minus at least."""
    return F.regexp_replace(c, MINUS_LAST, "-$1")


def remove_thousands_separators(c: Column) -> Column:
    """No commas and no white space anywhere."""
    return F.regexp_replace(c, GROUPING, "")


def cast_to_float64(c: Column) -> Column:
    """Double, or null for anything but a plain number (Spark's own cast also takes ``1d`` or hex)."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def percent_to_fraction(c: Column) -> Column:
    """``12%`` becomes 0.12, ``12`` stays 12.0, anything else is null."""
    return F.when(c.endswith("%"), cast_to_float64(F.regexp_replace(c, r"%\z", "")) / F.lit(100.0)).otherwise(cast_to_float64(c))
