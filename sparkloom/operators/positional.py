"""Positions.  Frames have no order of rows, so each operator names one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_A_PART = 60


def _cut_points(df: DataFrame, order: list[Column], n: int, parts: int) -> list[Column]:
    """At most parts - 1 places of the order, as literals, near evenly spaced by a sample of bounded size."""
    keys = df.select(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    share = min(1.0, SAMPLE_A_PART * parts / max(1, n))
    rows = (keys.sample(share, seed=17) if share < 1 else keys).orderBy(*keys.columns).limit(4 * SAMPLE_A_PART * parts).collect()
    picked = [rows[len(rows) * j // parts] for j in range(1, parts)] if len(rows) >= parts else rows[1:]
    distinct = list(dict.fromkeys(tuple(r) for r in picked))
    return [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, keys.schema.fields, strict=True))) for p in distinct]


def _part_of(key: Column, points: list[Column], low: int = 0) -> Column:
    """How many of the ascending points are at or before the key, by halving."""
    if not points:
        return F.lit(low)
    half = len(points) // 2
    return F.when(key >= points[half], _part_of(key, points[half + 1 :], low + half + 1)).otherwise(_part_of(key, points[:half], low))


def _hash_of_columns(df: DataFrame) -> Column:
    """Tells rows of one place apart; maps have no hash."""
    return F.xxhash64(*(f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()))


def zip_with_index(df: DataFrame, *order: str, name: str = "index", partitions: int | None = None) -> DataFrame:
    """``df`` with the position of each row in the order, from 0; nulls first, rows of one place by a hash of all their columns.

    The order is cut at places fixed beforehand (from a sample), rows are counted between them, and each part is numbered by
    itself and shifted by the counts before it.  As the places are literals, every evaluation puts a row into the same
    part, whatever columns are read with it.  Rows that are equal in all columns share a part.
    """
    n = df.count()
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order] + [_hash_of_columns(df)]
    points = _cut_points(df, keys, n, max(1, parts)) if n > parts else []
    struct = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys)))
    placed = df.withColumn("__part", _part_of(struct, points))
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row a part
    starts, at = [], 0
    for part in range(len(points) + 1):
        starts.append(F.lit(at).cast("long"))
        at += counts.get(part, 0)
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)).cast("long") - 1
    start = F.element_at(F.array(*starts), F.col("__part") + 1)
    return placed.withColumn(name, inner + start).drop("__part")


def zip_frames(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], *, strict: bool = False) -> DataFrame:
    """Rows with equal positions side by side; the longer side is cut, or an error with ``strict``."""
    if strict and a.count() != b.count():
        raise ValueError("the sides differ in length")
    return zip_with_index(a, *order_a, name="__i").join(zip_with_index(b, *order_b, name="__i"), "__i").drop("__i")


def zip_partitions(frames: list[DataFrame], f: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str, *, order: Sequence[str] = ()) -> DataFrame:
    """f over the k-th partitions of frames with one schema and as many partitions; a pair of partitions must fit a task.

    f gets each partition's rows in the order of the named columns, nulls first, rows of one place by a hash of all their
    columns.  Without a named order they come as the partition holds them, which differs from one evaluation to the next
    after a shuffle: its blocks are taken as they arrive.  So name one wherever f matches rows by their places.
    """
    counts = {df.rdd.getNumPartitions() for df in frames}
    if len(counts) != 1:
        raise ValueError("the frames differ in partitions")
    if order:
        frames = [df.sortWithinPartitions(*order, _hash_of_columns(df)) for df in frames]
    tagged = [df.withColumn("__p", F.spark_partition_id()).withColumn("__f", F.lit(i).cast("short")).withColumn("__s", F.monotonically_increasing_id()) for i, df in enumerate(frames)]
    all_rows = tagged[0]
    for t in tagged[1:]:
        all_rows = all_rows.unionByName(t)
    columns, n = frames[0].columns, len(frames)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = (group.loc[group["__f"] == i, [*columns, "__s"]] for i in range(n))  # one after the other, as they are large
        return f([side.sort_values("__s", ignore_index=True)[columns] for side in sides])

    return all_rows.groupBy("__p").applyInPandas(run, schema)
