"""Identifiers brought to their canonical form and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scrubwell.functions.values import pad_left
from scrubwell.operators.validate import assert_string_length
from scrubwell.plans.compose import compose_column

__all__ = "canonicalize_vin".split()

VIN_LENGTH = 17


def canonicalize_vin(df: DataFrame, column: str, *, ignore_null: bool = False) -> DataFrame:
    """VINs padded with zeros to 17 signs; raises if one is longer, or null unless ignored."""
    out = df.withColumn(column, compose_column(column, [pad_left(VIN_LENGTH)]))
    assert_string_length(out, column, min_length=VIN_LENGTH, max_length=VIN_LENGTH, ignore_null=ignore_null)
    return out
