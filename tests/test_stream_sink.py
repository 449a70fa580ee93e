"""Batches that replace themselves, lag from commits, and recorded progress."""

import contextlib

import pytest
from pyspark.errors import StreamingQueryException
from shop import order, shop

from tidemill.plans.verify import same_rows
from tidemill.sources.versioned import Files
from tidemill.streaming import ingest, monitor, producer, progress


def orders(spark, first, last):
    return shop(spark, orders=[order(i, 1, f"2024-01-{1 + i % 28:02d}") for i in range(first, last)])("bronze.orders")


def dies_after(write):
    def sink(batch, spec, number):
        if write:
            ingest.write_batch(batch, spec, number)
        raise OSError("killed")

    return sink


def run(spark, spec, **how):
    query = ingest.start(spark, spec, once=True, **how)
    with contextlib.suppress(StreamingQueryException):
        query.awaitTermination()


@pytest.mark.parametrize("write", [True, False])
def test_a_batch_that_was_killed_replaces_itself(spark, tmp_path, write):
    spec = ingest.stream_specs(f"file://{tmp_path}")["orders"]
    producer.send(orders(spark, 0, 40), spec)
    ingest.ingest_available(spark, spec)
    producer.send(orders(spark, 40, 70), spec)
    for _i in range(2):
        run(spark, spec, sink=dies_after(write))
    # What is written but not committed counts as behind, whether it can be seen or not.
    assert monitor.lag(spark, spec) == 30 and ingest.read_table(spark, spec).count() == (70 if write else 40)
    assert ingest.ingest_available(spark, spec) == 30 and monitor.lag(spark, spec) == 0
    assert same_rows(ingest.read_table(spark, spec), orders(spark, 0, 70))
    assert {r["number"]: r["read"] for r in ingest.committed(spark, spec).collect()} == {0: 40, 1: 30}


def test_a_new_checkpoint_replaces_nothing(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["orders"]
    producer.send(orders(spark, 0, 10), spec)
    ingest.ingest_available(spark, spec)
    Files(spark, spec.checkpoint).remove(spec.checkpoint)
    assert monitor.lag(spark, spec) == 0
    ingest.ingest_available(spark, spec)
    assert ingest.read_table(spark, spec).count() == 20 and monitor.lag(spark, spec) == -10


def test_one_file_for_each_day_of_a_backfill(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["orders"]
    producer.send(orders(spark, 0, 300).repartition(6), spec)
    ingest.ingest_available(spark, spec)
    files = [f for f, _, _ in Files(spark, spec.table).listing(spec.table) if f.endswith(".parquet")]
    assert len(files) == len({f.rsplit("/", 1)[0] for f in files}) == 28


def test_empty_batches_and_malformed_only(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["payments"]
    spark.createDataFrame([("[]",), ("x",)], "value string").write.mode("append").text(spec.source)
    run(spark, spec)
    assert ingest.read_table(spark, spec).count() == 0 and [tuple(r)[1:] for r in ingest.committed(spark, spec).collect()] == [(0, 2, 2)]


def test_recorded_progress(spark, tmp_path):
    place = f"file://{tmp_path}/progress"
    assert progress.recorded(spark, place).count() == 0 and progress.states(progress.recorded(spark, place)).count() == 0
    specs = ingest.stream_specs(f"file://{tmp_path}")
    recorder = progress.record(spark, place)
    try:
        producer.send(orders(spark, 0, 5), specs["orders"])
        run(spark, specs["orders"], sink=dies_after(True))
        progress.settle(spark)
        (failed,) = progress.states(progress.recorded(spark, place)).collect()
        assert (failed["state"], failed["batches"], failed["rows"]) == ("FAILED", 0, 0) and failed["error"]
        ingest.ingest_available(spark, specs["orders"])
        producer.send(orders(spark, 5, 9), specs["orders"])
        running = ingest.start(spark, specs["orders"])
        running.processAllAvailable()
        progress.settle(spark)
        (now,) = progress.states(progress.recorded(spark, place)).collect()
        assert (now["stream"], now["state"], now["batches"], now["rows"], now["error"]) == ("stream_orders", "RUNNING", 2, 9, None) and now["last_ms"] > 0
        running.stop()
        progress.settle(spark)
    finally:
        spark.streams.removeListener(recorder)
    # Another reader of the same place, with nothing of this process.
    (later,) = progress.states(spark.read.schema(progress.SCHEMA).option("recursiveFileLookup", "true").json(place)).collect()
    assert (later["state"], later["rows"], later["malformed"]) == ("STOPPED", 9, 0)


def test_rates_and_offsets(spark):
    rows = [("a", "progress", "q", "r", f"2024-01-01 00:0{m}:{s:02d}", i, n, 0, 5, e, latest, None) for i, (m, s, n, e, latest) in enumerate([(0, 0, 1000, 1, 9), (3, 0, 50, 4, 9), (3, 30, 40, 6, 12), (4, 0, 60, 11, 15)])]
    rows += [("a", "progress", "q", "r2", "2024-01-01 00:04:00", 3, 60, 0, 5, 11, 15, None), ("b", "progress", "q2", "r", "2024-01-01 00:00:00", 0, 7, 0, 5, 3, None, None)]
    df = spark.createDataFrame(rows, progress.SCHEMA.replace("at timestamp", "at string")).selectExpr("* except (at)", "cast(at as timestamp) as at")
    assert {r["stream"]: r["per_minute"] for r in progress.rates(df).collect()} == {"a": 100.0, "b": None}
    assert {r["stream"]: r["behind"] for r in progress.offsets_behind(df).collect()} == {"a": 4, "b": None}
    assert progress.offset_total(['{"orders":{"0":12,"1":7}}', '{"x":{"0":1}}']) == 20
    assert progress.offset_total(['{"logOffset":3}']) == 3 and progress.offset_total([None]) is None and progress.offset_total([""]) is None and progress.offset_total([]) is None
