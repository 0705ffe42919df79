"""Exact quantiles of a whole column, by linear interpolation.

``percentile`` keeps the distinct values of a column in one reducer. Beyond ``limit`` values the wanted ranks
are therefore closed in on first: an approximate quantile with a bounded rank error on either side, one
count of what lies below, and the same again on what lies between, until few enough distinct values are left to
rank them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMIT = 2_000_000
#: Rank error of an approximate quantile is at most one in so many rows.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, c: Column, points: list[float], *, limit: int = LIMIT, accuracy: int = ACCURACY) -> list[Column]:
    """A column (scalar subquery or literal) for each point; null where there are no values."""
    values = df.select(c.cast("double").alias("v")).filter("v IS NOT NULL")
    n = values.count()
    if n <= limit:
        row = values.select(F.percentile("v", F.array(*[F.lit(float(p)) for p in points])).alias("q")).scalar()
        return [row[i] for i in range(len(points))]
    out = []
    for p in points:
        rank = p * (n - 1)
        low, high = (_at(values, n, k, limit, accuracy) for k in (math.floor(rank), math.ceil(rank)))
        out.append(F.lit(low + (high - low) * (rank - math.floor(rank)) if high != low else low))
    return out


def _at(values: DataFrame, n: int, rank: int, limit: int, accuracy: int) -> float:
    """The value at a rank, counted from 0."""
    before = 0
    while True:
        share = (rank - before) / max(1, n - 1)
        sides = [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]
        a, b = values.select(F.percentile_approx("v", F.array(*map(F.lit, sides)), F.lit(accuracy))).first()[0]
        if sides[0] == 0.0 or sides[1] == 1.0:
            ends = values.agg(F.min("v"), F.max("v")).first()
            a, b = (ends[0] if sides[0] == 0.0 else a), (ends[1] if sides[1] == 1.0 else b)
        below, inside = values.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
        if not below <= rank - before < below + inside:
            raise AssertionError("an approximate quantile was off by more than its bound")
        slice_ = values.filter(F.col("v").between(a, b))
        counts = slice_.groupBy("v").agg(F.count("*").alias("n"))
        if inside <= limit or inside == n or counts.count() <= limit:
            upto = F.sum("n").over(Window.orderBy("v"))  # at most ``limit`` rows, or values that can't be told apart further
            return counts.withColumn("upto", upto).filter(F.col("upto") > rank - before - below).agg(F.min("v")).first()[0]
        values, n, before = slice_, inside, before + below
