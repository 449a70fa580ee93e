"""Streams of JSON objects into append-only tables.

One stream is read from Kafka or from a folder of JSON lines behind the same
interface: both give the value of each message, which ``from_json`` reads with the
declared schema.  Offsets live in the query's checkpoint, so a restart resumes where
it stopped and a first start reads from the beginning.

A micro-batch is written as a partition of its table that carries the batch's name, the
checkpoint's id and the batch's number, and overwrites that partition.  A batch that runs
again, since its commit was lost, replaces itself, so a kill at any point leaves no double
rows.  What a batch read is logged beside the table before the commit, so how far a stream
is can be told from its commits and this log, without counting rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.schemas import STREAM_DATES, STREAMS, schema
from ..sources.scratch import settings
from ..sources.versioned import Files

CHECKPOINT_SECONDS = 10
CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class StreamSpec:
    """topic folder or name, table folder, checkpoint folder of one stream."""

    name: str
    source: str
    table: str
    checkpoint: str
    kafka: str | None = None  # bootstrap servers; None: a folder of JSON lines


def stream_specs(root: str, kafka: str | None = None) -> dict[str, StreamSpec]:
    return {n: StreamSpec(n, n if kafka else f"{root}/topics/{n}", f"{root}/bronze/stream_{n}", f"{root}/checkpoints/{n}", kafka) for n in STREAMS}


def messages(spark: SparkSession, spec: StreamSpec, files_per_trigger: int | None = None) -> DataFrame:
    """The values of a stream's messages, from the earliest."""
    if spec.kafka:
        kafka = spark.readStream.format("kafka").option("kafka.bootstrap.servers", spec.kafka).option("subscribe", spec.source).option("startingOffsets", "earliest")
        return kafka.load().select(F.col("value").cast("string").alias("value"))
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(spec.source)


def parsed(values: DataFrame, table: str) -> DataFrame:
    """Messages as rows of a table; dates are ISO texts and a missing field is null.  Malformed messages give no row."""
    return _read(values, table).filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def malformed(values: DataFrame, table: str) -> DataFrame:
    """(value) of the messages that are no object of a table's schema."""
    return _read(values, table).filter(F.col(f"r.{CORRUPT}").isNotNull()).select("value")


def _read(values: DataFrame, table: str) -> DataFrame:
    row = F.from_json("value", schema(table).add(CORRUPT, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return values.filter(F.length(F.trim("value")) > 0).select("value", row.alias("r"))


def start(spark: SparkSession, spec: StreamSpec, once: bool = False, files_per_trigger: int | None = None, sink: Callable[[DataFrame, StreamSpec, int], None] | None = None) -> StreamingQuery:
    """Start appending a stream to its table; ``once`` reads what is there and stops.

    Malformed messages are left out and counted in the metric ``messages`` of each batch.
    ``sink`` writes a batch (None: ``write_batch``).
    """
    sink = sink or write_batch
    bad = F.count_if(F.col(f"r.{CORRUPT}").isNotNull()).alias("malformed")
    read = _read(messages(spark, spec, files_per_trigger), spec.name).observe("messages", F.count(F.lit(1)).alias("read"), bad)
    writer = read.writeStream.queryName(f"stream_{spec.name}").option("checkpointLocation", spec.checkpoint).foreachBatch(lambda batch, number: sink(batch, spec, number))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{CHECKPOINT_SECONDS} seconds")
    return writer.start()


#: The partition column that names a row's batch, and the log beside the table.
BATCH = "batch"


def log_of(spec: StreamSpec) -> str:
    return f"{spec.table}.log"


def checkpoint_id(files: Files, spec: StreamSpec) -> str:
    """The id that a checkpoint was made with; a new checkpoint has another, so its batches replace none of the old one's."""
    return json.loads(files.read_text(f"{spec.checkpoint}/metadata"))["id"]


def write_batch(batch: DataFrame, spec: StreamSpec, number: int) -> None:
    """Write one micro-batch under its own name, in place of what an earlier try has left, and log what it read.

    Rows are dealt out by day in a rebalancing shuffle, so a backfill writes a file for each
    day, and a day that is large when the rows are known is split among tasks.
    """
    files = Files(batch.sparkSession, spec.table)
    name = f"{checkpoint_id(files, spec)}-{number}"
    seen = Observation(f"batch-{uuid.uuid4().hex}")
    counted = batch.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col(f"r.{CORRUPT}").isNotNull()).alias("malformed"))
    rows = counted.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)
    days = [STREAM_DATES[spec.name]] if STREAM_DATES[spec.name] else []
    session = batch.sparkSession  # the query's own, so the setting holds for its batches only
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many days in one task would be written one after the other
    # A batch without good messages is not to be planned away, with its counts.
    session.conf.set("spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation")
    rows.hint("rebalance", int(session.conf.get("spark.sql.shuffle.partitions")), *days).write.mode("overwrite").partitionBy(*days).parquet(f"{spec.table}/{BATCH}={name}")
    files.write_text(f"{log_of(spec)}/{name}.json", json.dumps({"batch": name, "number": number, **seen.get}))


def committed(spark: SparkSession, spec: StreamSpec) -> DataFrame:
    """(batch, number, read, malformed) of every batch that is committed, also those of checkpoints before."""
    files = Files(spark, spec.table)
    if not files.names(log_of(spec)):
        return spark.createDataFrame([], _LOGGED)
    logged = spark.read.schema(_LOGGED).json(log_of(spec))
    if not files.exists(f"{spec.checkpoint}/metadata"):
        return logged
    # Batches of this checkpoint count once their commit is there; commits are removed from the oldest on.
    last = max([-1, *(int(n) for n in files.names(f"{spec.checkpoint}/commits") if n.isdigit())])
    own = F.startswith("batch", F.lit(checkpoint_id(files, spec)))
    return logged.filter(~own | (F.col("number") <= last))


_LOGGED = "batch string, number bigint, read bigint, malformed bigint"


def ingest_available(spark: SparkSession, spec: StreamSpec) -> int:
    """Append all that has arrived and wait for it; the rows of this run are returned."""
    query = start(spark, spec, once=True)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return _metric(query, "read")


def rejected(query: StreamingQuery) -> int:
    """Malformed messages that a query's recent batches left out."""
    return _metric(query, "malformed")


def _metric(query: StreamingQuery, name: str) -> int:
    return sum(p.observedMetrics["messages"][name] for p in query.recentProgress if "messages" in (p.observedMetrics or {}))


def register(spark: SparkSession, spec: StreamSpec, database: str) -> str:
    """Make a stream's table known to the catalog, under its own name; rows that arrive later are seen too."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    name = f"`{database}`.`stream_{spec.name}`"
    columns = ", ".join(f"`{c}`" for c in schema(spec.name).names)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{spec.table}`")
    return name


def read_table(spark: SparkSession, spec: StreamSpec) -> DataFrame:
    """The rows appended so far; an empty table before the first run."""
    if not Files(spark, spec.table).exists(spec.table):
        return spark.createDataFrame([], schema(spec.name))
    # One listing task for each of thousands of day folders takes longer than listing them.
    with settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}):
        return spark.read.schema(schema(spec.name).add(BATCH, "string")).parquet(spec.table).select(*schema(spec.name).names)


def reset(spark: SparkSession, spec: StreamSpec) -> None:
    """Stop the stream's queries and remove its table and checkpoint."""
    for q in spark.streams.active:
        if q.name == f"stream_{spec.name}":
            q.stop()
    files = Files(spark, spec.table)
    for p in (spec.table, log_of(spec), spec.checkpoint):
        files.remove(p)
