"""Checkpoints that outlive a session: Parquet and a list of its files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .manifest import AlreadyCommitted, publish, read_manifest, remove, sizes


def write_checkpoint(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows once and returns them without their lineage; a folder that has a checkpoint is left as it is.

    Each writer has a folder of its own; the first to publish its list of files wins, and the others remove theirs.
    """
    spark = df.sparkSession
    try:
        read_manifest(spark, path)
    except FileNotFoundError:
        folder = f"data-{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{path}/{folder}")
            files = [{"key": f"{folder}/{k}", "bytes": n} for k, n in sizes(spark, f"{path}/{folder}", ".parquet").items()]
            publish(spark, path, {"version": 1, "job": "checkpoint", "folder": folder, "partitions": files})
        except AlreadyCommitted:
            remove(spark, f"{path}/{folder}")
        except BaseException:
            remove(spark, f"{path}/{folder}")
            raise
    return read_checkpoint(spark, path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The rows; a missing or cut file is an error."""
    manifest = read_manifest(spark, path)
    have = sizes(spark, f"{path}/{manifest['folder']}", ".parquet")
    for f in manifest["partitions"]:
        if have.get(f["key"].rsplit("/", 1)[1]) != f["bytes"]:
            raise FileNotFoundError(f"checkpoint part {f['key']} is missing or cut")
    return spark.read.parquet(*(f"{path}/{f['key']}" for f in manifest["partitions"]))
