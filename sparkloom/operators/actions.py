"""Global aggregates and actions.  Over no rows, a reduction is None and an aggregate its zero."""

from __future__ import annotations

import copy
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


def reduce(df: DataFrame, agg: Column, name: str = "value") -> DataFrame:
    """One row with the aggregate; none over no rows."""
    return df.agg(F.count("*").alias("__n"), agg.alias(name)).where("__n > 0").drop("__n")


def fold(df: DataFrame, zero: Column, agg: Column, combine: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
    """One row: zero, which must be neutral, combined with the aggregate; zero over no rows."""
    return df.agg(F.coalesce(combine(zero, agg), zero).alias(name))


def tree_aggregate(df: DataFrame, **aggs: Column) -> DataFrame:
    """One row; partial sums on the map side."""
    return df.agg(*(a.alias(n) for n, a in aggs.items()))


def tree_aggregate_python(df: DataFrame, zero: object, seq: Callable, comb: Callable, depth: int = 2) -> object:
    """For state that no expression has: each partition starts with a copy of zero."""
    return df.rdd.treeAggregate(copy.deepcopy(zero), seq, comb, depth)


def count(df: DataFrame) -> int:
    return df.count()


def min_of(df: DataFrame, by: str) -> Row | None:
    """A row with the smallest value of ``by``, nulls apart; None without rows."""
    return df.where(F.col(by).isNotNull()).orderBy(F.col(by).asc()).first()


def max_of(df: DataFrame, by: str) -> Row | None:
    return df.where(F.col(by).isNotNull()).orderBy(F.col(by).desc()).first()


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order; no order, any n rows."""
    if n < 0:
        raise ValueError("n must not be negative")
    return (df.orderBy(*order) if order else df).limit(n)


def first(df: DataFrame, *order: str) -> Row | None:
    return (df.orderBy(*order) if order else df).first()


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def for_each(df: DataFrame, f: Callable) -> None:
    """f(row) on the executors; a retried task calls it again."""
    df.foreach(f)


def for_each_partition(df: DataFrame, f: Callable) -> None:
    """f(rows) once for each partition, empty ones too; a retried task calls it again."""
    df.foreachPartition(f)


def task_info() -> dict[str, int]:
    """Inside a task: its partition, stage and attempt; outside of one, nothing."""
    context = TaskContext.get()
    return {"partition": context.partitionId(), "stage": context.stageId(), "attempt": context.attemptNumber()} if context else {}


@contextmanager
def cancellable(spark: SparkSession, tag: str, *, seconds: float | None = None) -> Iterator[None]:
    """Jobs started inside belong to ``tag``: cancel() stops them, and so does the end of ``seconds``.

    A stopped action raises on the driver; its running tasks are interrupted.
    """
    context = spark.sparkContext
    context.addJobTag(tag)
    timer = threading.Timer(seconds, cancel, (spark, tag)) if seconds is not None else None
    if timer:
        timer.start()
    try:
        yield
    finally:
        if timer:
            timer.cancel()
        context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the running jobs of ``tag``; none is no error."""
    spark.sparkContext.cancelJobsWithTag(tag)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows, and metrics of those that the first finished action read: retried tasks count once."""
    seen = Observation()
    return df.observe(seen, *(m.alias(n) for n, m in metrics.items())), seen
