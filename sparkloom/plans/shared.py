"""Named broadcast values of a session, with the limits that keep them small."""

from __future__ import annotations

import pickle

from pyspark import Broadcast
from pyspark.sql import SparkSession

LIMIT = 8 << 20


class Broadcasts:
    """At most 8 MiB together; names of 1 to 128 characters, each once."""

    def __init__(self, spark: SparkSession, limit: int = LIMIT):
        self.spark, self.limit, self.used = spark, limit, 0
        self.values: dict[str, Broadcast] = {}

    def add(self, name: str, value: object) -> Broadcast:
        if not 1 <= len(name) <= 128:
            raise ValueError("a name has 1 to 128 characters")
        if name in self.values:
            raise ValueError(f"{name} is there already")
        size = len(pickle.dumps(value))
        if self.used + size > self.limit:
            raise ValueError(f"{name}: over {self.limit} bytes together")
        self.used += size
        self.values[name] = self.spark.sparkContext.broadcast(value)
        return self.values[name]

    def read(self, name: str) -> object:
        return self.values[name].value
