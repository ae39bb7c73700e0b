"""Sources and sinks defined by functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def function_source(spark: SparkSession, name: str, schema: str, partitions: int, read: Callable[[int], Iterator[tuple]]) -> DataFrame:
    """A frame whose partition i has the rows of read(i), called on the executors; registered as format ``name``."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(partitions)]

        def read(self, partition):
            yield from read(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return source_name

        def schema(self):
            return source_schema

        def reader(self, schema):
            return Reader()

    source_name, source_schema = name, schema
    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def save_with(df: DataFrame, base: str, write: Callable[[str, int, Iterator[str]], None]) -> None:
    """write(base, partition, lines) once for each partition that exists, empty ones too; ``df`` has one string column.

    A retried task calls it again: write to a name of its own and rename, or use commit().
    """
    column = df.columns[0]

    def run(rows):
        from pyspark import TaskContext

        write(base, TaskContext.get().partitionId(), (r[column] for r in rows))

    df.foreachPartition(run)


def save_partition(df: DataFrame, index: int, path: str) -> None:
    """Writes the lines of one partition."""
    if not 0 <= index < df.rdd.getNumPartitions():
        raise IndexError(f"no partition {index}")
    df.where(F.spark_partition_id() == index).write.text(path)
