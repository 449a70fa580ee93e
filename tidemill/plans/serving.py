"""Results for callers: rows, data frames, and a cache of results for a limited time."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession

TTL_SECONDS = 300
#: Rows of a result that is brought to a caller, at most; marts have fewer by far.
MOST_ROWS = 10_000


class TooManyRows(ValueError):
    """A result is larger than what a caller may fetch."""


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """One row more than allowed is enough to know that a result is too large."""
    return df.limit(most + 1)


def fetch(spark: SparkSession, query: str | DataFrame, most: int = MOST_ROWS) -> list[Row]:
    """All rows of a query, or TooManyRows."""
    df = spark.sql(query) if isinstance(query, str) else query
    rows = _bounded(df, most).collect()
    if len(rows) > most:
        raise TooManyRows(f"more than {most} rows; write the result to a table instead")
    return rows


def frame(spark: SparkSession, query: str | DataFrame, most: int = MOST_ROWS) -> pd.DataFrame:
    """A query's result as a pandas frame, by Arrow."""
    df = spark.sql(query) if isinstance(query, str) else query
    found = _bounded(df, most).toArrow()
    if found.num_rows > most:
        raise TooManyRows(f"more than {most} rows; write the result to a table instead")
    return found.to_pandas()


class ResultCache:
    """Results by key for ``ttl`` seconds; the longest unused one goes when there are too many."""

    def __init__(self, ttl: float = TTL_SECONDS, entries: int = 256, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.entries, self.clock = ttl, entries, clock
        self._held: OrderedDict[Any, tuple[float, Any]] = OrderedDict()

    def get(self, key: Any, build: Callable[[], Any]) -> Any:
        """The result under a key, built if there is none or it is too old."""
        now = self.clock()
        if key in self._held and now - self._held[key][0] < self.ttl:
            self._held.move_to_end(key)
            return self._held[key][1]
        found = build()
        self._held[key] = (now, found)
        self._held.move_to_end(key)
        while len(self._held) > self.entries:
            self._held.popitem(last=False)
        return found

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)
