"""What is known about streams: rows, lag, states and rates."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.quality import LAG_TOLERANCE
from ..sources import footers
from ..sources.schemas import DATES, KEYS, STREAM_DATES, schema
from ..sources.scratch import settings
from ..sources.versioned import Files
from .ingest import BATCH, StreamSpec, committed, read_table
from .producer import end_offset

RATE_WINDOW = 120
RATE_LEAST = 5
CATCH_UP_SECONDS = 180
POLL_SECONDS = 5


class CatchUpTimeout(RuntimeError):
    """Streams were still behind at the deadline; the text says which and by how much."""


class StreamMissing(RuntimeError):
    """A stream's table is not there yet; the text says what to do."""


def observe(spark: SparkSession, spec: StreamSpec, allow_empty: bool = False) -> DataFrame:
    """One row: rows, distinct keys, first and last date of a stream's table."""
    df = read_table(spark, spec)
    if not allow_empty and df.isEmpty():
        raise StreamMissing(f"the table of stream {spec.name} has no rows; start its ingest (streaming.ingest.start) and send messages first")
    return observed(df, spec.name)


def observed(df: DataFrame, name: str) -> DataFrame:
    date = F.col(DATES[name]) if name in DATES else F.lit(None).cast("date")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(KEYS[name]).alias("distinct_keys"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def observe_footers(spark: SparkSession, spec: StreamSpec) -> DataFrame:
    """One row: rows, first and last date of a stream's table, from file footers and partition names only."""
    path, date = spec.table, STREAM_DATES[spec.name]
    if not Files(spark, path).exists(path):
        return spark.createDataFrame([(0, None, None)], "rows bigint, first_date date, last_date date")
    with settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}):
        df = footers.table(spark, path, schema(spec.name).add(BATCH, "string"))
    # A stream's date is a partition column: its days and their rows are a small table.
    by = footers.answered(footers.partition_rows(df, date) if date else footers.ranges(df))
    day = F.col(date) if date else F.lit(None).cast("date")
    return by.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def lag(spark: SparkSession, spec: StreamSpec) -> int | None:
    """Messages that no committed batch has read yet; negative if they read more; None without topic.

    The topic's end and the log of batches tell it, so no rows are counted.
    """
    end = end_offset(spark, spec)
    return None if end is None else end - (committed(spark, spec).agg(F.sum("read")).first()[0] or 0)


def caught_up(spark: SparkSession, spec: StreamSpec, tolerance: int = LAG_TOLERANCE) -> bool:
    behind = lag(spark, spec)
    return behind is not None and abs(behind) <= tolerance


def await_caught_up(spark: SparkSession, specs: Sequence[StreamSpec], tolerance: int = LAG_TOLERANCE, deadline: float = CATCH_UP_SECONDS, poll: float = POLL_SECONDS, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Wait until every stream is within ``tolerance`` messages of its end; the lag of each, or CatchUpTimeout."""
    until = clock() + deadline
    while True:
        behind = {s.name: lag(spark, s) for s in specs}
        if all(n is not None and abs(n) <= tolerance for n in behind.values()):
            return behind
        if clock() >= until:
            raise CatchUpTimeout(f"still behind after {deadline} seconds: {behind}")
        sleep(poll)


def state(spark: SparkSession, spec: StreamSpec) -> dict[str, Any]:
    """State of a stream's query: running or not, batches, milliseconds of the last one."""
    for q in spark.streams.active:
        if q.name == f"stream_{spec.name}":
            progress = q.recentProgress
            return {"state": "RUNNING" if q.isActive else "STOPPED", "batches": len(progress), "last_ms": progress[-1]["batchDuration"] if progress else None}
    return {"state": "not running", "batches": 0, "last_ms": None}


def event_rate(samples: Sequence[tuple[float, int]], now: float) -> float | None:
    """Rows a minute from (time, rows) samples of the last two minutes; None until they span five seconds."""
    recent = [s for s in samples if now - s[0] <= RATE_WINDOW]
    if len(recent) < 2 or recent[-1][0] - recent[0][0] < RATE_LEAST:
        return None
    return (recent[-1][1] - recent[0][1]) / (recent[-1][0] - recent[0][0]) * 60


def summary(spark: SparkSession, specs: Sequence[StreamSpec], rows: Callable[[StreamSpec], int] | None = None) -> list[dict[str, Any]]:
    """Rows, end and state by stream; a stream that cannot be read says why and does not stop the others."""
    out = []
    for spec in specs:
        try:
            n = rows(spec) if rows else committed(spark, spec).agg(F.coalesce(F.sum(F.col("read") - F.col("malformed")), F.lit(0))).first()[0]
            out.append({"stream": spec.name, "rows": n, "end": end_offset(spark, spec), **state(spark, spec)})
        except Exception as e:  # reported, not raised
            out.append({"stream": spec.name, "error": str(e).splitlines()[0]})
    return out
