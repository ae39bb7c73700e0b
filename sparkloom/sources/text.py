"""Lines of text files, in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import within


def text_file(spark: SparkSession, path: str | list[str], *, max_line_bytes: int | None = None, missing_ok: bool = False) -> DataFrame:
    """Column ``value``: the lines of a file, or of all files below a folder.

    Lines end at a line feed; one carriage return before it is dropped.  Files whose names begin with a dot or an
    underscore are skipped.  A longer line than ``max_line_bytes`` fails the job.  A missing path is an
    error, or no lines with ``missing_ok``.
    """
    try:
        lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "value string")
        raise
    lines = lines.select(F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.select(within("value", max_line_bytes, "a line is over the limit").alias("value")) if max_line_bytes else lines


def line(*columns: Column | str) -> Column:
    """A row as text: the values between braces, separated by a blank; null is <nil>."""
    return F.concat(F.lit("{"), F.concat_ws(" ", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("<nil>")) for c in columns)), F.lit("}"))


def save_text(df: DataFrame, path: str, *columns: Column | str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """Writes one line a row: the single string column, or ``columns`` as line() has them."""
    out = df.select(line(*columns).alias("value")) if columns else df
    out.write.mode(mode).text(path, compression=compression)
