"""Transforms put together: over a column, or over a frame where a transform needs the data."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import quoted_name
from scrubwell.functions.stats import DataDependent
from scrubwell.types import ColumnTransform

__all__ = "apply_recipe compose_column".split()


def _steps(transforms: Iterable[ColumnTransform]) -> list[ColumnTransform]:
    steps = list(transforms)
    if not steps:
        raise ValueError("transforms must not be empty")
    return steps


def compose_column(source: str, transforms: Iterable[ColumnTransform], output: str | None = None, *, df: DataFrame | None = None) -> Column:
    """The transforms applied in turn to the column ``source``, named ``output`` (or as the source).

    Transforms that need figures of the whole column take them from ``df``, the frame the column is used on; without it they
    raise, as the only plan left would put all rows into one partition.
    """

    def step(c: Column, t: ColumnTransform) -> Column:
        return t.apply_column(df, c) if isinstance(t, DataDependent) and df is not None else t(c)

    return reduce(step, _steps(transforms), F.col(quoted_name(source))).alias(output or source)


def apply_recipe(df: DataFrame, source: str, transforms: Iterable[ColumnTransform], output: str | None = None) -> DataFrame:
    """``df`` with the column; runs of pure transforms are one projection, data-dependent ones use the frame."""
    name = output or source
    at, pure = source, []
    for step in _steps(transforms):
        if isinstance(step, DataDependent):
            if pure:
                df, at, pure = df.withColumn(name, compose_column(at, pure)), name, []
            df, at = step.apply_frame(df, at, name), name
        else:
            pure.append(step)
    return df.withColumn(name, compose_column(at, pure)) if pure else df
