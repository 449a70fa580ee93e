"""Malformed messages, registration, order, the catch-up gate, interleaving and the Kafka side's settings."""

import pytest
from pyspark.sql import functions as F
from shop import order, shop

from tidemill.sources.versioned import Files
from tidemill.streaming import ingest, monitor, producer


def orders(spark, n):
    return shop(spark, orders=[order(i, 1) for i in range(1, n + 1)])("bronze.orders")


def test_malformed_messages_are_left_out_and_counted(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["orders"]
    producer.send(orders(spark, 3), spec)
    bad = spark.createDataFrame([("{broken",), ("[1]",), ("  ",)], "value string")
    bad.coalesce(1).write.mode("append").text(spec.source)
    query = ingest.start(spark, spec, once=True)
    query.awaitTermination()
    assert ingest.read_table(spark, spec).count() == 3 and ingest.rejected(query) == 2
    values = spark.read.schema("value string").text(spec.source)
    assert sorted(r[0] for r in ingest.malformed(values, "orders").collect()) == ["[1]", "{broken"]
    assert ingest.parsed(values, "orders").filter("order_id is null").count() == 0


def test_registered_table_sees_later_rows(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["orders"]
    producer.send(orders(spark, 2), spec)
    ingest.ingest_available(spark, spec)
    name = ingest.register(spark, spec, "bronze_test")
    assert spark.table(name).count() == 2
    producer.send(orders(spark, 1), spec)
    ingest.ingest_available(spark, spec)
    assert spark.table(name).count() == 3 and ingest.register(spark, spec, "bronze_test") == name
    spark.sql("DROP DATABASE bronze_test CASCADE")


def test_order_and_end(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["orders"]
    assert producer.end_offset(spark, spec) is None
    assert producer.send(orders(spark, 40).repartition(7), spec, "order_id") == 40 and producer.end_offset(spark, spec) == 40
    names = sorted(n for n in Files(spark, spec.source).names(spec.source) if n.startswith("part-"))
    lines = [r[0] for n in names for r in spark.read.text(f"{spec.source}/{n}").collect()]
    assert lines == sorted(lines) and len(lines) == 40


def test_gate_waits_until_the_deadline(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["orders"]
    producer.send(orders(spark, 3), spec)
    now = [0.0]

    def wait(seconds):
        now[0] += seconds

    with pytest.raises(monitor.CatchUpTimeout, match="orders"):
        monitor.await_caught_up(spark, [spec], tolerance=2, deadline=12, poll=5, clock=lambda: now[0], sleep=wait)
    assert now[0] == 15.0
    assert monitor.await_caught_up(spark, [spec], tolerance=3, clock=lambda: now[0], sleep=wait) == {"orders": 3}
    ingest.ingest_available(spark, spec)
    assert monitor.await_caught_up(spark, [spec], tolerance=0, clock=lambda: now[0], sleep=wait) == {"orders": 0} and now[0] == 15.0


def test_two_streams_on_one_clock(spark, tmp_path):
    specs = ingest.stream_specs(f"file://{tmp_path}")
    times = producer.timeline(spark, {"orders": (200, 0.5), "web_events": (2000, 0.05)})
    last = {r["stream"]: (r["n"], r["t"]) for r in times.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("arrival").alias("t")).collect()}
    assert last["orders"][0] == 200 and last["web_events"][0] == 2000
    assert 70 < last["orders"][1] < 140 and 80 < last["web_events"][1] < 120  # 100 seconds each
    assert times.filter("arrival <= 0").count() == 0
    sent = producer.drop_interleaved({"orders": (orders(spark, 6), "order_id", 0.5), "payments": (shop(spark)("bronze.payments").limit(0), "payment_id", 1.0)}, specs, 1.0)
    assert sum(s["orders"] for s in sent) == 6 and producer.end_offset(spark, specs["orders"]) == 6 and len(sent) > 1


def test_kafka_settings(spark):
    spec = ingest.stream_specs("unused", kafka="broker:9092")["orders"]
    assert (spec.source, spec.kafka) == ("orders", "broker:9092")
    assert producer.kafka_options(spec)["kafka.bootstrap.servers"] == "broker:9092" and producer.kafka_options(spec)["kafka.acks"] == "1"
    producer.ensure_topic(spark, spec)  # the broker makes it
    with pytest.raises(ValueError):
        producer.reset_topic(spark, spec)
    with pytest.raises(Exception, match="(?i)kafka"):  # no connector here: it is asked for, and no folder is written
        producer.send(orders(spark, 1), spec)
