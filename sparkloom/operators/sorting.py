"""Total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_by_key(df: DataFrame, *keys: str, ascending: bool = True, partitions: int | None = None) -> DataFrame:
    """Rows in order across and within partitions: sampled ranges, then a sort of each that spills."""
    order = [F.col(k).asc() if ascending else F.col(k).desc() for k in keys]
    return df.repartitionByRange(partitions, *order).sortWithinPartitions(*order) if partitions else df.orderBy(*order)
