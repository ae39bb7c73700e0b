"""Projections, filters and partition-wise operators; none of them shuffles."""

from __future__ import annotations

import itertools
import math
import subprocess
import tempfile
import threading
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def map_rows(df: DataFrame, **exprs: Column) -> DataFrame:
    """The named expressions, a row a row."""
    return df.select(*(e.alias(n) for n, e in exprs.items()))


def flat_map(df: DataFrame, array: Column, name: str = "value", *keep: str) -> DataFrame:
    """A row for each element; null and empty arrays give none."""
    return df.select(*keep, F.explode(array).alias(name))


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def map_values(df: DataFrame, key: str, **exprs: Column) -> DataFrame:
    return df.select(key, *(e.alias(n) for n, e in exprs.items()))


def flat_map_values(df: DataFrame, key: str, array: Column, name: str = "value") -> DataFrame:
    return df.select(key, F.explode(array).alias(name))


def keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key)


def values(df: DataFrame, *value: str) -> DataFrame:
    return df.select(*value)


def key_by(df: DataFrame, expr: Column, name: str = "key") -> DataFrame:
    return df.withColumn(name, expr)


def map_partitions(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """f over the batches of each partition.  A callable is opaque to the optimiser: filter and select before it."""
    return df.mapInPandas(f, schema)


def map_partitions_with_index(df: DataFrame, f: Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return f(TaskContext.get().partitionId(), batches)

    return df.mapInPandas(run, schema)


def glom(df: DataFrame, column: str, name: str = "rows") -> DataFrame:
    """An array for each partition, an empty one for those without rows; a partition's values must fit a task."""
    kind = df.schema[column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0) for b in batches]
        values = pa.concat_arrays(held) if held else pa.array([], arrow_type)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], names=[name])

    arrow_type = to_arrow_type(df.schema[column].dataType)
    return df.select(column).mapInArrow(run, f"{name} array<{kind}>")


def pipe(df: DataFrame, command: str, column: str = "value") -> DataFrame:
    """Lines through a shell command, one process a partition; an exit but 0 fails the task with what it wrote to stderr.

    Lines are fed and taken as they come, so a partition needs no memory for them.  A null is an empty line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as said, subprocess.Popen(["sh", "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=said) as process:
            failed: list[BaseException] = []

            def feed() -> None:
                try:
                    with process.stdin as to:
                        for batch in batches:
                            to.write("".join(f"{'' if x is None else x}\n" for x in batch.column(0).to_pylist()).encode())
                except BrokenPipeError:
                    pass  # the command has read what it wants
                except BaseException as e:  # of the rows themselves: the task fails with it
                    failed.append(e)

            feeder = threading.Thread(target=feed)
            feeder.start()
            while lines := list(itertools.islice(process.stdout, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array([x.decode().removesuffix("\n") for x in lines], pa.string())], names=["value"])
            feeder.join()
            if failed:
                raise failed[0]
            if process.wait():
                said.seek(0)
                raise RuntimeError(f"pipe: exit {process.returncode}: {said.read().decode(errors='replace')}")

    return df.select(F.col(column).cast("string").alias("value")).mapInArrow(run, "value string")


def sample(df: DataFrame, fraction: float, *, replacement: bool = False, seed: int | None = None) -> DataFrame:
    return df.sample(replacement, fraction, seed)


def random_split(df: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    """Disjoint parts that together are ``df``; the same on every run over the same partitions.  A weight of 0 gives an empty part."""
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be finite and not negative, with a positive sum")
    return df.randomSplit([float(w) for w in weights], seed)
