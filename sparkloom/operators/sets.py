"""Set operations on whole rows."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, by column names; repeated rows stay."""
    if not frames:
        raise ValueError("union of no frames")
    return fold(DataFrame.unionByName, frames)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have."""
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b hasn't, as often as a has them; null equals null."""
    y = b.select(a.columns).distinct().toDF(*(f"__{c}" for c in a.columns))
    return a.join(y, fold(lambda p, q: p & q, (F.equal_null(F.col(c), F.col(f"__{c}")) for c in a.columns)), "left_anti")
