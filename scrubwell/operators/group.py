"""One row per group, and nulls filled from the group.

Input order is what ``order_by`` says; without it, the order of files and partitions, taken down before
any shuffle, which is only the same again on a repeated evaluation where the frame is read from files.

Null keys are a group, rows that repeat count each, an empty table gives an empty result, and columns keep their values
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from scrubwell.functions.columns import free_names, quoted_name

__all__ = """
CentralTendencyStrategy fill_null_numeric_by_group fill_null_string_by_group
first_non_null_per_group mode_then_first_per_group
""".split()

type CentralTendencyStrategy = Literal["auto", "mean", "median"]


def _ordered(df: DataFrame, order_by: str | Sequence[str] | None, name: str) -> DataFrame:
    if order_by is None:
        return df.withColumn(name, F.monotonically_increasing_id())
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.withColumn(name, F.struct(*[F.col(quoted_name(n)) for n in names]))


def _keys(keys: Sequence[str], what: str = "keys") -> list[str]:
    if not keys or isinstance(keys, str):
        raise ValueError(f"{what} must be a sequence of column names and not empty")
    return [quoted_name(k) for k in keys]


def first_non_null_per_group(df: DataFrame, keys: Sequence[str], *, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """A row per key with each other column's first value that isn't null. One shuffle for all columns."""
    by = _keys(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*by).distinct()
    (order,) = free_names(df, "order")
    first = [F.expr(f"min_by({quoted_name(c)}, {quoted_name(order)}) FILTER (WHERE {quoted_name(c)} IS NOT NULL)").alias(c) for c in rest]
    return _ordered(df, order_by, order).groupBy(*by).agg(*first)


def _modes(df: DataFrame, by: list[str], columns: list[str], order_by: str | Sequence[str] | None) -> DataFrame:
    """A row per key: each column's most frequent value that isn't null, the earliest among equals; null if it has none.

    A row becomes one for each column, with that column's value in the field of its own type, so all columns are counted and
    ranked in one pass of two shuffles, both with map-side combination.
    """
    (order,) = free_names(df, "order")
    fields = [f"v{i}" for i in range(len(columns))]
    types = [df.select(quoted_name(c)).schema[0].dataType for c in columns]
    each = [
        F.struct(
            F.lit(i).alias("which"),
            *[(F.col(quoted_name(c)) if k == i else F.lit(None).cast(types[k])).alias(fields[k]) for k, c in enumerate(columns)],
        )
        for i in range(len(columns))
    ]
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(by)]
    long = _ordered(df, order_by, order).select(*keys, F.col(quoted_name(order)).alias("order"), F.explode(F.array(*each)).alias("row"))
    names = [f"k{i}" for i in range(len(by))]
    flat = long.select(*names, "order", "row.*")
    counts = flat.groupBy(*names, "which", *fields).agg(F.count("*").alias("n"), F.min("order").alias("at"))
    best = [
        F.expr(f"min_by({f}, struct(-n, at)) FILTER (WHERE which = {i} AND {f} IS NOT NULL)").alias(f) for i, f in enumerate(fields)
    ]
    return counts.groupBy(*names).agg(*best)


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], take: Sequence[tuple[str, str]]) -> DataFrame:
    """Left join in which null keys match; ``right`` has the keys as ``k0``, ...; ``take``: (column of right, new name)."""
    names = free_names(left, *[f"k{i}" for i in range(len(keys))])
    r = right.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], *[F.col(a).alias(b) for a, b in take])
    same = reduce(Column.__and__, [left[quoted_name(k)].eqNullSafe(r[n]) for k, n in zip(keys, names)])
    return left.join(r, same, "left").drop(*names)


def mode_then_first_per_group(df: DataFrame, keys: Sequence[str], *, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """A row per key with each other column's most frequent value, the earliest among equals; null if it has none."""
    by = _keys(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*by).distinct()
    modes = _modes(df, by, rest, order_by)
    return modes.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"v{i}").alias(c) for i, c in enumerate(rest)])


def _medians(df: DataFrame, by: list[str], c: Column) -> DataFrame:
    """``k0``, ... and ``middle``, the exact median per key.

    Values are counted first, so repeats don't travel; the running count of a group is sorted and spills, and holds no group in
    memory, where ``percentile`` holds the distinct values of one.
    """
    names = [f"k{i}" for i in range(len(by))]
    counts = df.select(*[F.col(k).alias(n) for k, n in zip(by, names)], c.alias("v")).filter("v IS NOT NULL").groupBy(*names, "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*names)
    ranked = counts.withColumn("upto", F.sum("n").over(group.orderBy("v"))).withColumn("total", F.sum("n").over(group))
    holds = lambda rank: f"(upto > {rank} AND upto - n <= {rank})"
    picked = ranked.filter(f"{holds('(total - 1) div 2')} OR {holds('total div 2')}")
    return picked.groupBy(*names).agg(((F.min("v") + F.max("v")) / 2).alias("middle"))


def fill_null_numeric_by_group(
    df: DataFrame, value: str, groups: Sequence[str], *, strategy: CentralTendencyStrategy = "auto", skew_threshold: float = 1.0,
    output: str | None = None,
) -> DataFrame:
    """Nulls become the group's mean or median, as double. ``auto``: the median if the column's skewness
    reaches the threshold in size. A group without values stays null; text that is no number raises."""
    by = _keys(groups, "groups")
    if strategy not in ("auto", "mean", "median"):
        raise ValueError("strategy must be 'auto', 'mean' or 'median'")
    if skew_threshold < 0:
        raise ValueError("skew_threshold must not be negative")
    c = F.col(quoted_name(value)).cast("double")
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(by)]
    means = lambda rows: rows.groupBy(*keys).agg(F.avg(c).alias("middle"))
    if strategy == "auto":
        skewed = F.coalesce(F.abs(df.select(F.skewness(c)).scalar()) >= skew_threshold, F.lit(False))
        figures = means(df.filter(~skewed)).unionAll(_medians(df.filter(skewed), by, c))  # the filter leaves one of them without rows
    else:
        figures = means(df) if strategy == "mean" else _medians(df, by, c)
    (middle,) = free_names(df, "middle")
    joined = _join_on(df, figures, groups, [("middle", middle)])
    return joined.withColumn(output or value, F.coalesce(c, F.col(middle))).drop(*([middle] if middle != (output or value) else []))


def fill_null_string_by_group(
    df: DataFrame, value: str, groups: Sequence[str], *, order_by: str | Sequence[str] | None = None, output: str | None = None
) -> DataFrame:
    """Nulls become the group's most frequent value, the earliest among equals; the type stays."""
    by = _keys(groups, "groups")
    (mode,) = free_names(df, "mode")
    joined = _join_on(df, _modes(df, by, [value], order_by), groups, [("v0", mode)])
    done = F.coalesce(F.col(quoted_name(value)), F.col(mode))
    return joined.withColumn(output or value, done).drop(*([mode] if mode != (output or value) else []))
