"""Streams of text lines, under the rules of the batch source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Column ``value``: lines of the files that appear in a folder."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.regexp_replace("value", "\r$", "").alias("value"))
