"""Parquet in and out, and temporary views for SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``<folder>/<name>.parquet``; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    for name in names:
        read_table(spark, folder, name).createOrReplaceTempView(name)


def write_table(df: DataFrame, folder: str, name: str, *, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/{name}.parquet")
