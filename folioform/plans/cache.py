"""A cache of tables by key, least recently used out first, with its statistics."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class TableCache:
    """Persisted tables by key; at most ``capacity`` at a time. Spark holds the rows, the driver only names."""

    def __init__(self, capacity: int = 16) -> None:
        self.capacity, self.tables = capacity, OrderedDict[str, DataFrame]()
        self.hits = self.misses = self.evictions = 0

    def get(self, key: str, load: Callable[[], DataFrame]) -> DataFrame:
        """The table under ``key``, loaded and persisted if it is not there."""
        if key in self.tables:
            self.hits += 1
            self.tables.move_to_end(key)
            return self.tables[key]
        self.misses += 1
        self.tables[key] = load().persist()
        if len(self.tables) > self.capacity:
            self.evictions += 1
            self.tables.popitem(last=False)[1].unpersist()
        return self.tables[key]

    def drop(self, key: str) -> None:
        if (t := self.tables.pop(key, None)) is not None:
            t.unpersist()

    def clear(self) -> None:
        while self.tables:
            self.tables.popitem()[1].unpersist()

    def stats(self, spark: SparkSession) -> DataFrame:
        """(size, capacity, hits, misses, evictions, hit_rate): one row."""
        asked = self.hits + self.misses
        return spark.createDataFrame([(len(self.tables), self.capacity, self.hits, self.misses, self.evictions, round(self.hits / asked, 6) if asked else 0.0)], "size int, capacity int, hits int, misses int, evictions int, hit_rate double")
