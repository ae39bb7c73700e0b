"""Frames from rows in the program, ranges and Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def from_rows(spark: SparkSession, rows: Iterable, schema: str, partitions: int | None = None) -> DataFrame:
    df = spark.createDataFrame(list(rows), schema)
    return df.repartition(partitions) if partitions else df


def make_range(spark: SparkSession, start: int, end: int, step: int = 1, partitions: int | None = None) -> DataFrame:
    """Column ``id``: start, start + step, ... before end.  A step of 0 is an error; one away from end gives no rows."""
    if not step:
        raise ValueError("step must not be 0")
    return spark.range(start, end, step, partitions)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
