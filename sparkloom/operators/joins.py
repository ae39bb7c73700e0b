"""Equi-joins on named keys.  The optimiser picks the strategy; null keys match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import checked_groups


def join(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.join(b, list(keys), "inner")


def _flagged(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str, left: str, right: str) -> DataFrame:
    out = a.withColumn(left, F.lit(True)).join(b.withColumn(right, F.lit(True)), list(keys), how)
    return out.withColumn(left, F.coalesce(left, F.lit(False))).withColumn(right, F.coalesce(right, F.lit(False)))


def left_join(a: DataFrame, b: DataFrame, *keys: str, flag: str = "has_right") -> DataFrame:
    """``flag`` tells an absent row from one with nulls."""
    return _flagged(a, b, keys, "left", "__left", flag).drop("__left")


def right_join(a: DataFrame, b: DataFrame, *keys: str, flag: str = "has_left") -> DataFrame:
    return _flagged(a, b, keys, "right", flag, "__right").drop("__right")


def full_join(a: DataFrame, b: DataFrame, *keys: str, left: str = "has_left", right: str = "has_right") -> DataFrame:
    return _flagged(a, b, keys, "full", left, right)


def subtract_by_key(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows of a, repeated ones too, whose key b doesn't have; null keys stay."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def cogroup(a: DataFrame, b: DataFrame, key: str, left: str, right: str, *, max_group: int | None = None) -> DataFrame:
    """Each key of either side with the sorted values of both; an absent side has an empty array.

    A key with more than ``max_group`` rows on one side fails the job before its group is gathered.
    """
    x = checked_groups(a, key, max_group).groupBy(key).agg(F.sort_array(F.collect_list(left)).alias("__l"))
    y = checked_groups(b, key, max_group).groupBy(key).agg(F.sort_array(F.collect_list(right)).alias("__r"))
    none = lambda df, c: F.array().cast(dict(df.dtypes)[c])
    return x.join(y, key, "full").select(key, F.coalesce("__l", none(x, "__l")).alias("left_values"), F.coalesce("__r", none(y, "__r")).alias("right_values"))


def cartesian(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of rows: for small sides."""
    return a.crossJoin(b)


def lookup(df: DataFrame, key: str, wanted: object, *value: str) -> DataFrame:
    """The values of one key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(wanted)).select(*value)


def broadcast_lookup(df: DataFrame, dim: DataFrame, key: str, default: dict[str, Column], *, max_bytes: int = 8 << 20) -> DataFrame:
    """Left join that goes to all tasks if the optimiser's size of ``dim`` is at most ``max_bytes``, and shuffles otherwise; absent values are the defaults."""
    size = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    out = df.join(F.broadcast(dim) if size <= max_bytes else dim, key, "left")
    return out.withColumns({c: F.coalesce(c, v) for c, v in default.items()})
