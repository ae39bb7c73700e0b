"""Frames kept across jobs under a name, as long as their plan stays the same."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

LEVELS = {"memory": StorageLevel.MEMORY_ONLY, "disk": StorageLevel.DISK_ONLY, "memory_and_disk": StorageLevel.MEMORY_AND_DISK}


class Kept:
    def __init__(self) -> None:
        self.frames: dict[str, DataFrame] = {}

    def persist(self, name: str, df: DataFrame, level: str = "memory_and_disk") -> DataFrame:
        """The kept frame of that name and plan; another plan under the name replaces it."""
        have = self.frames.get(name)
        if have is not None and have.sameSemantics(df):
            return have
        self.unpersist(name)
        self.frames[name] = df.persist(LEVELS[level])
        return self.frames[name]

    def unpersist(self, name: str) -> None:
        if (df := self.frames.pop(name, None)) is not None:
            df.unpersist()

    def stop(self) -> None:
        for name in list(self.frames):
            self.unpersist(name)
