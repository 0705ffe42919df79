"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import cut


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges`` (``a``, ``b``).

    Each round is two shuffles with map-side minima; edges are cut to the checkpoint folder, never
    collected. The number of rounds grows with the logarithm of the largest component's diameter.
    """
    now = cut(_lower(edges))
    sign = None
    for _ in range(max_rounds):
        after = cut(_small_star(_large_star(now)))
        new = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if new == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        sign = new
    raise RuntimeError("components did not settle")


def _lower(edges: DataFrame) -> DataFrame:
    """Edges from the greater to the smaller node, once each, without loops."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
