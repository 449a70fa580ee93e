"""Producers: tables as JSON messages, the whole history or a live tail after it.

A topic is a Kafka topic, or a folder of JSON lines to which each drop of files is
appended atomically.  A folder keeps the number of messages of each drop in its log, so
its end is known without reading it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import id_number, padded_id
from ..sources.generator import CHANNELS, DEVICES, EVENT_TYPES, PAYMENT_METHODS, choose, uniform
from ..sources.schemas import KEYS, STREAMS
from ..sources.versioned import Files
from .ingest import StreamSpec

LIVE_KNOWN = 0.7
LIVE_EVENT_SECONDS = 0.05
LIVE_ORDER_SECONDS = 0.5


def to_messages(df: DataFrame) -> DataFrame:
    """One JSON object for each row; dates as ISO texts, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}).alias("value"))


LOG = "_log"  # Spark does not read what begins with an underscore


def send(df: DataFrame, spec: StreamSpec, in_order_of: str | None = None) -> int:
    """Append rows to a topic; with ``in_order_of`` in the order of a column. Messages sent.

    The order of a folder is that of its files' names and of the lines in each.
    """
    if in_order_of:
        df = df.repartitionByRange(in_order_of).sortWithinPartitions(in_order_of)
    seen = Observation(f"sent-{uuid.uuid4().hex}")
    messages = to_messages(df).observe(seen, F.count(F.lit(1)).alias("n"))
    if spec.kafka:
        messages.write.format("kafka").options(**kafka_options(spec), topic=spec.source).save()
        return seen.get["n"]
    messages.write.mode("append").text(spec.source)
    sent = seen.get["n"]
    files = Files(df.sparkSession, spec.source)
    files.write_text(f"{spec.source}/{LOG}/{uuid.uuid4().hex}-{sent}", "")
    return sent


def kafka_options(spec: StreamSpec) -> dict[str, str]:
    return {"kafka.bootstrap.servers": spec.kafka, "kafka.acks": "1", "kafka.linger.ms": "20", "kafka.batch.size": "65536"}


def ensure_topic(spark: SparkSession, spec: StreamSpec) -> None:
    """A folder is made; a Kafka topic is made by its broker when it is first written to."""
    if not spec.kafka:
        files = Files(spark, spec.source)
        files.fs.mkdirs(files.path(spec.source))


def reset_topic(spark: SparkSession, spec: StreamSpec) -> None:
    if spec.kafka:
        raise ValueError(f"topic {spec.source} is deleted with the tools of its broker, not from here")
    Files(spark, spec.source).remove(spec.source)
    ensure_topic(spark, spec)


def end_offset(spark: SparkSession, spec: StreamSpec) -> int | None:
    """Messages in a topic; None if there is no such topic."""
    if spec.kafka:
        read = spark.read.format("kafka").option("kafka.bootstrap.servers", spec.kafka).option("subscribe", spec.source).option("startingOffsets", "earliest").option("endingOffsets", "latest").load()
        ends = read.groupBy("partition").agg((F.max("offset") - F.min("offset") + 1).alias("n"))
        return ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = Files(spark, spec.source)
    if not files.exists(spec.source):
        return None
    return sum(int(name.rsplit("-", 1)[1]) for name in files.names(f"{spec.source}/{LOG}"))


def replay(spark: SparkSession, tables: dict[str, DataFrame], specs: dict[str, StreamSpec], if_empty: bool = False, reset_topics: bool = False) -> dict[str, int]:
    """Send whole tables in the order of their keys; with ``if_empty`` a topic that has messages is left alone. Messages sent, by topic."""
    sent = {}
    for name in STREAMS:
        if name not in tables:
            continue
        if reset_topics:
            reset_topic(spark, specs[name])
        ensure_topic(spark, specs[name])
        if if_empty and end_offset(spark, specs[name]):
            sent[name] = 0
            continue
        sent[name] = send(tables[name], specs[name], KEYS[name])
    return sent


def _clock(df: DataFrame, seed: int, salt: str, mean_seconds: float, last: DataFrame) -> DataFrame:
    """A date for each row of a simulated clock that starts the day after the last date; gaps are exponential."""
    gap = -F.log(uniform(seed, f"{salt}-gap", F.col("i"))) * F.lit(mean_seconds)
    elapsed = F.sum(gap).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    clocked = df.crossJoin(F.broadcast(last)).withColumn("arrival", elapsed)
    return clocked.withColumn("day", F.date_add(F.date_add("last_date", 1), F.floor(F.col("arrival") / 86400).cast("int")))


def live_events(spark: SparkSession, events: DataFrame, customers: DataFrame, n: int, seed: int = 42, mean_seconds: float = LIVE_EVENT_SECONDS) -> DataFrame:
    """``n`` new web events after the known ones; ids continue, and seven in ten have a known customer."""
    last = events.agg(F.max("event_date").alias("last_date"), F.max(id_number("event_id")).alias("last_id"))
    known = customers.select("customer_id", (F.row_number().over(Window.orderBy("customer_id")) - 1).alias("k"))
    size = customers.agg(F.count(F.lit(1)).alias("size"))
    e = _clock(spark.range(1, n + 1).withColumnRenamed("id", "i"), seed, "event", mean_seconds, last).crossJoin(F.broadcast(size))
    pick = F.floor(uniform(seed, "event-customer", F.col("i")) * F.col("size")).cast("int")
    e = e.withColumn("k", F.when(uniform(seed, "event-known", F.col("i")) < LIVE_KNOWN, pick)).join(known, "k", "left")
    return e.select(
        padded_id("EVT", F.col("last_id") + F.col("i"), 8).alias("event_id"), "customer_id", choose(uniform(seed, "event-type", F.col("i")), EVENT_TYPES).alias("event_type"),
        F.lit("Electronics").alias("category"), choose(uniform(seed, "event-device", F.col("i")), DEVICES).alias("device"), F.col("day").alias("event_date"),
    )


def live_orders(spark: SparkSession, orders: DataFrame, items: DataFrame, payments: DataFrame, customers: DataFrame, products: DataFrame, n: int, seed: int = 42, mean_seconds: float = LIVE_ORDER_SECONDS) -> dict[str, DataFrame]:
    """``n`` new orders, each with 1 to 5 items and one payment: keys resolve, cancelled orders fail, none is returned."""
    last = orders.agg(F.max("order_date").alias("last_date"), F.max(id_number("order_id")).alias("last_id"))
    last = last.crossJoin(payments.agg(F.max(id_number("payment_id")).alias("last_payment"))).crossJoin(items.agg(F.max(id_number("order_item_id")).alias("last_item")))
    sizes = customers.agg(F.count(F.lit(1)).alias("n_customers")).crossJoin(products.agg(F.count(F.lit(1)).alias("n_products")))
    c = customers.select("customer_id", (F.row_number().over(Window.orderBy("customer_id")) - 1).alias("c"))
    p = products.select("product_id", F.col("unit_price").cast("double").alias("price"), (F.row_number().over(Window.orderBy("product_id")) - 1).alias("p"))
    i = F.col("i")
    o = _clock(spark.range(1, n + 1).withColumnRenamed("id", "i"), seed, "order", mean_seconds, last).crossJoin(F.broadcast(sizes))
    o = o.withColumn("c", F.floor(uniform(seed, "order-customer", i) * F.col("n_customers")).cast("int")).join(c, "c")
    o = o.select("i", "day", "last_item", "n_products", "customer_id", padded_id("ORD", F.col("last_id") + i, 7).alias("order_id"), padded_id("PAY", F.col("last_payment") + i, 7).alias("payment_id"), F.when(uniform(seed, "order-cancelled", i) < 0.09, "cancelled").otherwise("completed").alias("order_status"), choose(uniform(seed, "order-channel", i), CHANNELS).alias("channel"), (F.floor(uniform(seed, "order-lines", i) * 5) + 1).cast("int").alias("lines"))
    before = F.sum("lines").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    lines = o.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("line", F.explode(F.sequence(F.lit(1), F.col("lines"))))
    at = F.col("i") * 10 + F.col("line")
    lines = lines.withColumn("p", F.floor(uniform(seed, "line-product", at) * F.col("n_products")).cast("int")).join(p, "p")
    quantity = (F.floor(uniform(seed, "line-quantity", at) * 5) + 1).cast("int")
    lines = lines.select("order_id", "product_id", padded_id("OI", F.col("last_item") + F.col("before") + F.col("line"), 8).alias("order_item_id"), quantity.alias("quantity"), F.col("price").alias("unit_price"), F.round(quantity * F.col("price"), 2).alias("line_total"))
    totals = lines.groupBy("order_id").agg(F.round(F.sum("line_total"), 2).alias("total_amount"))
    o = o.join(totals, "order_id")
    status = F.when(F.col("order_status") == "cancelled", "failed").when(uniform(seed, "order-pending", i) < 0.03, "pending").otherwise("succeeded")
    return {
        "orders": o.select("order_id", "customer_id", F.col("day").alias("order_date"), "order_status", "channel", "total_amount"),
        "order_items": lines.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_total"),
        "payments": o.select("payment_id", "order_id", choose(uniform(seed, "order-method", i), PAYMENT_METHODS).alias("payment_method"), status.alias("payment_status"), F.col("day").alias("payment_date"), F.col("total_amount").alias("amount")),
    }


def timeline(spark: SparkSession, counts: dict[str, tuple[int, float]], seed: int = 42) -> DataFrame:
    """(arrival, stream, i): the i-th arrivals of several paced streams on one clock, in seconds, from (number, mean gap) by stream."""
    out = None
    for name, (n, mean) in sorted(counts.items()):
        one = _clock(spark.range(1, n + 1).withColumnRenamed("id", "i"), seed, name, mean, spark.createDataFrame([(None,)], "last_date date"))
        one = one.select("arrival", F.lit(name).alias("stream"), "i")
        out = one if out is None else out.unionByName(one)
    return out


def drop_interleaved(live: dict[str, tuple[DataFrame, str, float]], specs: dict[str, StreamSpec], step_seconds: float, seed: int = 42) -> list[dict[str, int]]:
    """Send several live streams as they would arrive together: a drop for every ``step_seconds`` of the common clock.

    ``live`` has (rows, key, mean gap in seconds) by stream; rows arrive in the order of
    their keys.  The messages sent, by stream, for each step.
    """
    due = {}
    last = 0
    for name, (df, key, mean) in live.items():
        spark = df.sparkSession
        numbered = df.withColumn("i", F.row_number().over(Window.orderBy(key)).cast("long"))
        clock = timeline(spark, {name: (df.count(), mean)}, seed).select("i", F.floor(F.col("arrival") / step_seconds).cast("int").alias("step"))
        due[name] = (numbered.join(clock, "i").drop("i"), key)
        last = max(last, clock.agg(F.max("step")).first()[0] or 0)
    return [{name: send(df.filter(F.col("step") == step).drop("step"), specs[name], key) for name, (df, key) in due.items()} for step in range(last + 1)]


def drop_in_ticks(df: DataFrame, spec: StreamSpec, key: str, ticks: int) -> None:
    """Send rows in key order as several drops, so that a running query sees them arrive bit by bit."""
    parts = df.withColumn("__tick", F.ntile(ticks).over(Window.orderBy(key)))
    for t in range(1, ticks + 1):
        send(parts.filter(F.col("__tick") == t).drop("__tick"), spec)
