"""Column expressions used by operators and workloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(text: Column | str) -> Column:
    """The parts of a text between white space; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strip_marks(word: Column | str, marks: str = ".,;:!") -> Column:
    """A word without the given characters at both ends."""
    return F.btrim(word, F.lit(marks))


def byte_length(text: Column | str) -> Column:
    """Length in UTF-8 bytes, as bigint."""
    return F.octet_length(text).cast("long")


def nan_free(key: Column | str, message: str = "NaN key") -> Column:
    """The key; a NaN fails the job when it is read."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.isnan(key), F.raise_error(message)).otherwise(key)


def within(value: Column | str, limit: int, message: str = "over the limit") -> Column:
    """The value; one of more than ``limit`` bytes fails the job when it is read."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.octet_length(value) > limit, F.raise_error(message)).otherwise(value)
