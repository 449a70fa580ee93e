"""Progress of streaming queries as a table, written by a listener.

Every start, progress and end of a query is a JSON file in a folder by stream, named by run
and batch, so an event that is told twice is one row.  What is asked of it (states, batches,
durations, rates) is SQL over that table: it survives the process, and sees queries of
other processes that write to the same place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.versioned import Files

SCHEMA = "stream string, event string, query string, run string, at timestamp, batch bigint, rows bigint, malformed bigint, duration_ms bigint, end_offset bigint, latest_offset bigint, error string"


class Recorder(StreamingQueryListener):
    """Appends the events of all named queries of a session to the table under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.names: dict[str, str] = {}

    def _write(self, stream: str, event: str, query: str, run: str, at: str, batch: int | None = None, **more) -> None:
        row = {"stream": stream, "event": event, "query": query, "run": run, "at": at, "batch": batch} | more
        self.files.write_text(f"{self.root}/{stream}/{run}-{event}{'' if batch is None else f'-{batch}'}.json", json.dumps(row) + "\n")

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self._write(self.names[str(event.runId)], "started", str(event.id), str(event.runId), event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = (p.observedMetrics or {}).get("messages")
        self._write(
            p.name or str(p.id), "progress", str(p.id), str(p.runId), p.timestamp, p.batchId, rows=seen["read"] if seen else p.numInputRows, malformed=seen["malformed"] if seen else 0, duration_ms=p.batchDuration,
            end_offset=offset_total([s.endOffset for s in p.sources]), latest_offset=offset_total([s.latestOffset for s in p.sources]),
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        now = self.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\")").first()[0]
        error = event.exception.splitlines()[0] if event.exception else None
        self._write(self.names.get(run, str(event.id)), "terminated", str(event.id), run, now, error=error)


def record(spark: SparkSession, root: str) -> Recorder:
    """Record from now on; ``spark.streams.removeListener`` ends it."""
    recorder = Recorder(spark, root)
    spark.streams.addListener(recorder)
    return recorder


def settle(spark: SparkSession, milliseconds: int = 30_000) -> None:
    """Wait until events that have happened are recorded."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(milliseconds)


def recorded(spark: SparkSession, root: str) -> DataFrame:
    """All recorded events; an empty table before the first."""
    if not Files(spark, root).names(root):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(root)


def batches(events: DataFrame) -> DataFrame:
    """One row for each batch of a query: the last time that it ran."""
    last = F.row_number().over(Window.partitionBy("stream", "query", "batch").orderBy(F.desc("at"), "run"))
    return events.filter("event = 'progress'").withColumn("_last", last).filter("_last = 1").drop("_last")


def states(events: DataFrame) -> DataFrame:
    """(stream, state, batches, rows, malformed, last_ms, last_at, error) by stream: RUNNING, STOPPED or FAILED by its latest run."""
    run = F.max_by("run", F.struct("at", F.col("event") != "started")).alias("run")
    latest = events.join(events.groupBy("stream").agg(run), ["stream", "run"])
    ended = latest.groupBy("stream").agg(F.max(F.col("event") == "terminated").alias("ended"), F.max("error").alias("error"), F.max("at").alias("last_at"))
    done = batches(events).groupBy("stream").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.sum("malformed").alias("malformed"), F.max_by("duration_ms", "at").alias("last_ms"))
    state = F.when(F.col("error").isNotNull(), "FAILED").when(F.col("ended"), "STOPPED").otherwise("RUNNING")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("batches", "rows", "malformed")]
    return ended.join(done, "stream", "left").select("stream", state.alias("state"), *zero, "last_ms", "last_at", "error")


def rates(events: DataFrame, seconds: int = 120) -> DataFrame:
    """(stream, per_minute): rows of the batches in the last ``seconds`` before a stream's newest one, from the times between them."""
    own = batches(events)
    newest = own.groupBy("stream").agg(F.max("at").alias("newest"))
    near = own.join(newest, "stream").filter(F.col("at") >= F.col("newest") - F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)")))
    span = F.col("last").cast("double") - F.col("first").cast("double")
    sums = near.groupBy("stream").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("rows").alias("rows"), F.min_by("rows", "at").alias("before"))
    # The first batch's rows came before its time.
    return sums.select("stream", F.when(span >= 5, (F.col("rows") - F.col("before")) / span * 60).alias("per_minute"))


def offsets_behind(events: DataFrame) -> DataFrame:
    """(stream, behind): offsets between the end of each stream's source and what its newest batch read; null where the source does not tell its end."""
    newest = batches(events).groupBy("stream").agg(F.max_by(F.struct("end_offset", "latest_offset"), "at").alias("o"))
    return newest.select("stream", (F.col("o.latest_offset") - F.col("o.end_offset")).alias("behind"))


def offset_total(offsets: list[str | None]) -> int | None:
    """The sum of all numbers in the offsets of a query's sources, such as {"topic": {"0": 12, "1": 7}}; None if one is unknown."""

    def total(x) -> int:
        return sum(map(total, x.values())) if isinstance(x, dict) else int(x)

    try:
        known = [json.loads(o) if isinstance(o, str) else o for o in offsets]
        return sum(map(total, known)) if known else None
    except (TypeError, ValueError):  # no offset, or one that is no number
        return None
