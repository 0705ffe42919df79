"""Recipes on streams. Pure transforms are stateless, so they run on a stream as on a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from scrubwell.functions.stats import DataDependent
from scrubwell.plans.compose import compose_column
from scrubwell.types import ColumnTransform

__all__ = "clean_stream".split()


def clean_stream(stream: DataFrame, recipes: Mapping[str, Iterable[ColumnTransform]]) -> DataFrame:
    """``stream`` with each named column cleaned in place by its recipe.

    A transform that needs figures of the whole column has none on a stream and is refused.
    """
    steps = {column: list(recipe) for column, recipe in recipes.items()}
    for column, recipe in steps.items():
        if any(isinstance(t, DataDependent) for t in recipe):
            raise ValueError(f"the recipe of {column!r} needs the whole column, which a stream doesn't have")
    return stream.withColumns({column: compose_column(column, recipe) for column, recipe in steps.items()})
