"""Aggregation by key.

Expressions are pre-aggregated on the map side.  A Python callable sees a key's whole group in one task: bound it
with ``max_group`` and prefer expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_by_key(df: DataFrame, *keys: str, **aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggs.items()))


def checked_groups(df: DataFrame, key: str, max_group: int | None) -> DataFrame:
    """``df``; a key with more than ``max_group`` rows fails the job before any group is gathered.

    Keys are counted with partial sums, and only whether one is over the limit comes back, as a scalar subquery.
    """
    if max_group is None:
        return df
    over = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max_group).limit(1).agg(F.count("*").alias("n")).scalar()
    return df.where(F.when(over > 0, F.raise_error(F.lit("a group is over the limit")).cast("boolean")).otherwise(F.lit(True)))


def group_by_key(df: DataFrame, key: str, value: str, *, name: str = "values", max_group: int | None = None) -> DataFrame:
    """Each key with its sorted values; a group of more than ``max_group`` fails the job before it is gathered."""
    return checked_groups(df, key, max_group).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def combine_by_key(df: DataFrame, key: str, create: Callable[[Column], Column], merge: Callable[[Column], Column], *, value: str, name: str = "combined", finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """create: a value's combiner; merge: an aggregate over combiners, which must not depend on their order; finish: its result."""
    out = df.groupBy(key).agg(merge(create(F.col(value))).alias(name))
    return out.withColumn(name, finish(F.col(name))) if finish else out


def aggregate_by_key(df: DataFrame, key: str, zero: Column, seq: Callable[[Column, Column], Column], merge: Callable[[Column], Column], *, value: str, name: str = "aggregate") -> DataFrame:
    """Every row gives seq(zero, value); merge aggregates those.  So zero counts once a row, however rows lie in partitions."""
    return df.groupBy(key).agg(merge(seq(zero, F.col(value))).alias(name))


def fold_by_key(df: DataFrame, key: str, zero: Column, add: Callable[[Column, Column], Column], merge: Callable[[Column], Column], *, value: str, name: str = "folded") -> DataFrame:
    return aggregate_by_key(df, key, zero, add, merge, value=value, name=name)


def count_by_key(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def count_by_value(df: DataFrame, name: str = "n") -> DataFrame:
    return count_by_key(df, *df.columns, name=name)


def reduce_values(df: DataFrame, key: str, value: str, f: Callable, result_type: str, *, max_group: int = 1_000_000, name: str = "reduced") -> DataFrame:
    """f over a key's values two by two, for functions that no expression has; a larger group than ``max_group`` is an error."""

    def run(group):
        if len(group) > max_group:
            raise ValueError("a group is over the limit")
        got = None
        for i, v in enumerate(group[value]):
            got = v if not i else f(got, v)
        return group[[key]].head(1).assign(**{name: [got]})

    return df.select(key, value).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, {name} {result_type}")
