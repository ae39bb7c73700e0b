"""How rows lie in partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repartition(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n partitions (1 at least): by hash of the keys, or evenly."""
    return df.repartition(max(1, n), *keys)


def coalesce(df: DataFrame, n: int) -> DataFrame:
    """At most n partitions, without a shuffle."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    return df.coalesce(n)


def repartition_by_range(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartitionByRange(n, *keys)


def partition_by(df: DataFrame, n: int, key: str, place: Callable | None = None) -> DataFrame:
    """Rows in the partition that ``place`` (a function of a Column to one) or the key itself names, modulo n."""
    spot = place(F.col(key)) if place else F.col(key)
    return df.repartitionById(n, F.pmod(spot.cast("long"), F.lit(n)).cast("int"))
