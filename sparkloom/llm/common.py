"""What several operators share: tables, lineage cuts, connected components, grouped Arrow tasks."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


EDGES_A_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with its lineage cut at the reliable checkpoint folder.

    The folder is the one the cluster names in spark.checkpoint.dir; only where none is named (tests
    on one machine) a temporary one is set.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name below the one that spark.checkpoint.dir names.

    Where it is unset (tests on one machine) the folder of the context's checkpoints is taken, or a temporary one set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_folder(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``folder``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, u: str, v: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge the smallest node that links reach.

    Alternates large-star and small-star steps until the edges are stars.  Minima are pre-aggregated
    and joined back, so that a node with very many neighbours is no single task; every round is cut.
    Nulls in either column are ignored, as are loops.  An empty input gives no rows.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = fingerprint(e)
    tasks = -(-seen[0] // EDGES_A_TASK)  # the number of edges never grows
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        e = cut(small.where("u <> v").distinct().coalesce(tasks))
        now = fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: no fixed point; raise max_rounds")
    star = e.groupBy("u").agg(F.min("v").alias("v"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def numbered(rows: DataFrame, group: str, key: str, ties: list[str], bits: int, rows_a_task: int) -> DataFrame:
    """``rows`` with ``i``: the place of each row in its group, from 0 without gaps, in the order of ``key`` (a number of so many bits), then ``ties``.

    Rows are numbered in buckets of the key, and the buckets' counts shift them; so no task holds a whole group.  Where one key
    has more rows than a task should take, it becomes buckets of its own, cut by the first of the ties (64 bits).
    The rows must be the same whenever they are computed; rows equal in key and ties take their places by chance, so
    ties should leave none that differ.
    """
    total = rows.count()
    cut_at = bits - max(0, math.ceil(math.log2(max(1, total) / rows_a_task)))
    placed = rows.withColumn("bucket", F.shiftright(key, cut_at)).withColumn("part", F.lit(0)).withColumn("slice", F.lit(0))
    heavy = placed.groupBy(group, "bucket").agg(F.count("*").alias("n")).where(F.col("n") > 4 * rows_a_task).select(group, "bucket")
    if not heavy.isEmpty():
        hot = placed.join(heavy, [group, "bucket"], "left_semi").groupBy(group, "bucket", key).agg(F.count("*").alias("n")).where(F.col("n") > 2 * rows_a_task)
        hot = cut(hot.groupBy(group, "bucket").agg(F.array_sort(F.collect_list(key)).alias("hot"), F.max("n").alias("most")))  # of a bucket at most as many as its rows / rows_a_task
        placed = placed.drop("part", "slice").join(hot, [group, "bucket"], "left")
        own = F.coalesce(F.array_contains("hot", F.col(key)), F.lit(False))
        below = F.coalesce(F.size(F.filter("hot", lambda x: x < F.col(key))), F.lit(0))
        slices = F.ceil(F.col("most") / rows_a_task)
        # The first tie's upper 31 bits, from 0 on, in as many slices.
        upper = F.shiftright(ties[0], 33) + F.lit(1 << 30)
        placed = placed.withColumn("part", 2 * below + own.cast("int")).withColumn("slice", F.when(own, F.floor(upper * slices / F.lit(1 << 31)).cast("int")).otherwise(0)).drop("hot", "most")
    at = ["bucket", "part", "slice"]
    before = Window.partitionBy(group).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    start = placed.groupBy(group, *at).agg(F.count("*").alias("n")).select(group, *at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy(group, *at).orderBy(key, *ties)) - 1
    return placed.withColumn("inner", inner).join(start, [group, *at]).withColumn("i", F.col("start") + F.col("inner")).drop(*at, "inner", "start")


def rows_of_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows with equal keys, of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        at = 0
        for i, key in enumerate(zip(*cols, strict=True)):
            if key != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, key
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def arrow_groups(df: DataFrame, keys: list[str], order: list[str | Column], f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the groups of ``keys``, each in the given order; one exchange, batches stay Arrow's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows_of_groups(batches, keys):
            yield from f(group)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
