"""Transforms that need figures of the whole column.

Each is a :class:`DataDependent` and needs the frame: :func:`scrubwell.plans.compose.apply_recipe` takes it, and
``compose_column`` does as ``df=``. Figures are distributed aggregates in scalar subqueries or exact quantiles (which run jobs when the
column is built, see :mod:`scrubwell.functions.quantiles`); frequencies are a join with the table of values, so they need
``apply_recipe``. Nulls stay null and count for no figure; a column without values has null figures; an empty table stays empty;
repeated rows each count; columns of the frame keep their values whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubwell.functions.columns import free_names, quoted_name
from scrubwell.functions.quantiles import exact_quantiles
from scrubwell.types import ColumnTransform

__all__ = """
clip_numeric collapse_keep_top_n collapse_rare_by_count flag_iqr_outliers flag_mad_outliers
flag_zscore_outliers map_categories winsorize_numeric
""".split()


type Bound = float | None
type Share = float


@dataclass(frozen=True)
class DataDependent:
    """``on``: (frame, column) to a column of figures of that frame, where there is one. ``framed``: (frame, column name, output
    name) to a frame. ``pure``: what it does to a column of unknown type without a frame, where that makes sense."""

    framed: Callable[[DataFrame, str, str], DataFrame]
    on: Callable[[DataFrame, Column], Column] | None = None
    pure: ColumnTransform | None = None

    def __call__(self, c: Column) -> Column:
        if self.pure is None:
            raise ValueError("the transform needs the whole column: give compose_column the frame as df=, or use apply_recipe")
        return self.pure(c)

    def apply_column(self, df: DataFrame, c: Column) -> Column:
        if self.on is None:
            raise ValueError("the transform joins a table of frequencies: use apply_recipe")
        return self.on(df, c)

    def apply_frame(self, df: DataFrame, column: str, output: str | None = None) -> DataFrame:
        return self.framed(df, column, output or column)


def _on_column(on: Callable[[DataFrame, Column], Column], pure: ColumnTransform | None = None) -> DataDependent:
    return DataDependent(lambda df, column, output: df.withColumn(output, on(df, F.col(quoted_name(column)))), on, pure)


def _by_figures(figures: Callable[[Column], list[Column]], result: Callable[[Column, list[Column]], Column]) -> DataDependent:
    """Figures are plain aggregates of the column."""

    def on(df: DataFrame, c: Column) -> Column:
        row = df.select(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(figures(c))]).alias("f")).scalar()
        return result(c, [row[f"f{i}"] for i in range(len(figures(c)))])

    return _on_column(on)


def _by_quantiles(points: list[float], result: Callable[[Column, list[Column]], Column]) -> DataDependent:
    """Figures are exact quantiles of the column."""
    return _on_column(lambda df, c: result(c, exact_quantiles(df, c, points)))


def flag_zscore_outliers(threshold: float = 3.0) -> DataDependent:
    """|x - mean| over the sample deviation above ``threshold``; false on a constant column, null for one value."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")

    def result(c: Column, f: list[Column]) -> Column:
        mean, std = f
        constant = F.when(c.isNotNull(), F.lit(False))
        return F.when(std == 0, constant).otherwise(F.abs((c - mean) / F.when(std != 0, std)) > threshold)

    return _by_figures(lambda c: [F.avg(c), F.stddev_samp(c)], result)


def flag_iqr_outliers(multiplier: float = 1.5) -> DataDependent:
    """Beyond the quartiles by more than ``multiplier`` interquartile ranges."""
    if multiplier <= 0:
        raise ValueError("multiplier must be positive")

    def result(c: Column, f: list[Column]) -> Column:
        q1, q3 = f
        reach = multiplier * (q3 - q1)
        return (c < q1 - reach) | (c > q3 + reach)

    return _by_quantiles([0.25, 0.75], result)


def flag_mad_outliers(threshold: float = 3.5) -> DataDependent:
    """0.6745 |x - median| over the median absolute deviation above ``threshold``; where that is 0, anything off the median."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")

    def result(c: Column, median: Column, mad: Column) -> Column:
        return F.when(mad == 0, c != median).otherwise(F.abs(0.6745 * (c - median) / F.when(mad != 0, mad)) > threshold)

    def on(df: DataFrame, c: Column) -> Column:
        (median,) = exact_quantiles(df, c, [0.5])
        (mad,) = exact_quantiles(df, F.abs(c - median), [0.5])
        return result(c, median, mad)

    return _on_column(on)


def _clip(c: Column, lower, upper) -> Column:
    """Clamped, null kept; ``least`` and ``greatest`` would drop nulls."""
    out = F
    if lower is not None:
        out = out.when(c < lower, lower)
    if upper is not None:
        out = out.when(c > upper, upper)
    return out.otherwise(c)


def _same_type(df: DataFrame, c: Column, value: Column) -> Column:
    """Whole-number columns stay so; bounds are cut to whole numbers."""
    kind = df.select(c.alias("c")).schema["c"].dataType
    return value.cast(kind) if isinstance(kind, T.NumericType) else value


def _whole(bound: Bound) -> Bound:
    """A whole bound as an int, which leaves the type of whole-number columns alone."""
    return int(bound) if bound is not None and float(bound).is_integer() and abs(bound) < 2**63 else bound


def clip_numeric(lower: Bound = None, upper: Bound = None) -> DataDependent:
    """Clamped to the inclusive bounds. The type stays where the frame is at hand, else with whole bounds; a fractional bound
    without the frame makes a whole-number column double."""
    if lower is None and upper is None:
        raise ValueError("give lower, upper or both")
    if None not in (lower, upper) and lower > upper:
        raise ValueError("lower must not exceed upper")
    bounds = (_whole(lower), _whole(upper))
    return _on_column(lambda df, c: _same_type(df, c, _clip(c, *bounds)), lambda c: _clip(c, *bounds))


def winsorize_numeric(lower_quantile: Share = 0.05, upper_quantile: Share = 0.95) -> DataDependent:
    """Clamped to two quantiles of the column (linear interpolation)."""
    if not 0 <= lower_quantile < upper_quantile <= 1:
        raise ValueError("quantiles must satisfy 0 <= lower < upper <= 1")
    points = [lower_quantile, upper_quantile]
    return _on_column(lambda df, c: _same_type(df, c, _clip(c, *exact_quantiles(df, c, points))))


def map_categories(mapping: Mapping[Hashable, object]) -> ColumnTransform:
    """Whole values remapped; others are cast to the type of the mapping's values. ``None`` may be a key."""
    if not mapping:
        raise ValueError("mapping must not be empty")
    kinds = {type(v) for v in mapping.values() if v is not None}
    kind = {str: "string", bool: "boolean", int: "long", float: "double"}.get(kinds.pop() if len(kinds) == 1 else str, "string")

    def value(v) -> Column:
        return F.lit(v).cast(kind)

    def transform(c: Column) -> Column:
        out = F.when(c.isNull(), value(mapping.get(None)))
        for k, v in mapping.items():
            if k is not None:
                out = out.when(c == F.lit(k), value(v))
        return out.otherwise(c.cast(kind))

    return transform


def _by_frequency(chosen: Callable[[DataFrame], DataFrame], replacement: str) -> DataDependent:
    """``chosen``: from the table of (value, n) to the values that are replaced."""

    def framed(df: DataFrame, column: str, output: str) -> DataFrame:
        c = F.col(quoted_name(column))
        value, gone = free_names(df, "value", "gone")
        counts = df.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"))
        rare = chosen(counts).select(F.col("value").alias(value), F.lit(True).alias(gone))
        names = [F.col(quoted_name(x)) for x in df.columns]
        joined = df.join(rare, c == F.col(value), "left")
        done = F.when(F.col(gone), F.lit(replacement)).otherwise(c)
        kept = [done.alias(x) if x == output else n for x, n in zip(df.columns, names)]
        return joined.select(*kept, *([] if output in df.columns else [done.alias(output)]))

    return DataDependent(framed)


def collapse_rare_by_count(min_count: int, replacement: str = "other") -> DataDependent:
    """Values of fewer than ``min_count`` rows become ``replacement``; null stays."""
    if min_count < 1:
        raise ValueError("min_count must be at least 1")

    return _by_frequency(lambda t: t.filter(F.col("n") < min_count), replacement)


def collapse_keep_top_n(n: int, replacement: str = "other") -> DataDependent:
    """Values outside the ``n`` highest frequencies become ``replacement``; ties share a tier, null stays.

    The tiers come from the table of distinct frequencies: the ``n`` largest, a bounded top-k.
    """
    if n < 1:
        raise ValueError("n must be at least 1")

    def chosen(counts: DataFrame) -> DataFrame:
        least = counts.select("n").distinct().orderBy(F.desc("n")).limit(n).select(F.min("n")).scalar()
        return counts.filter(F.col("n") < least)

    return _by_frequency(chosen, replacement)
