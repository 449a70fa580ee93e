"""Counts and ranges from footers: the plan reads no rows, and the values are those of the rows."""

import pytest
from pyspark.sql import functions as F
from shop import d, order, shop

from tidemill.sources import footers
from tidemill.streaming import ingest, monitor, producer


def test_ranges_come_from_footers(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else d(f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}"), str(i)) for i in range(500)]
    spark.createDataFrame(rows, "k int, day date, t string").repartition(5).write.parquet(f"file://{tmp_path}/t")
    df = footers.table(spark, f"file://{tmp_path}/t")
    plan = footers.plan(footers.ranges(df, "day", "k"))
    assert "PushedAggregation: [COUNT(*), MIN(day), MAX(day), MIN(k), MAX(k)]" in plan
    want = spark.createDataFrame(rows, "k int, day date, t string").agg(F.count(F.lit(1)), F.min("day"), F.max("day"), F.min("k"), F.max("k")).first()
    assert tuple(footers.answered(footers.ranges(df, "day", "k")).first()) == tuple(want)
    with pytest.raises(ValueError, match="statistics"):
        footers.ranges(df, "t")


def test_empty_and_all_null(spark, tmp_path):
    spark.createDataFrame([], "k int, day date").write.parquet(f"file://{tmp_path}/e")
    spark.createDataFrame([(None, None)] * 3, "k int, day date").write.parquet(f"file://{tmp_path}/n")
    for name, n in (("e", 0), ("n", 3)):
        assert tuple(footers.answered(footers.ranges(footers.table(spark, f"file://{tmp_path}/{name}"), "day")).first()) == (n, None, None)


def test_partition_rows_are_pushed(spark, tmp_path):
    spark.range(300).selectExpr("id % 3 AS part", "id").write.partitionBy("part").parquet(f"file://{tmp_path}/p")
    counts = footers.partition_rows(footers.table(spark, f"file://{tmp_path}/p"), "part")
    assert "PushedGroupBy: [part]" in footers.plan(counts) and sorted(tuple(r) for r in footers.answered(counts).collect()) == [(0, 100), (1, 100), (2, 100)]


def test_stream_observer(spark, tmp_path):
    spec = ingest.stream_specs(f"file://{tmp_path}")["orders"]
    assert tuple(monitor.observe_footers(spark, spec).first()) == (0, None, None)
    for first in (1, 20):
        producer.send(shop(spark, orders=[order(i, 1, f"2024-01-{i:02d}") for i in range(first, first + 5)])("bronze.orders"), spec)
        ingest.ingest_available(spark, spec)
    assert tuple(monitor.observe_footers(spark, spec).first()) == (10, d("2024-01-01"), d("2024-01-24"))
