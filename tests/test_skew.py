"""Salted joins against plain ones, and how rows are spread."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemill.operators.skew import HOWS, hot_keys, salted_join
from tidemill.sources.scratch import settings


def sides(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"), (F.col("id") % 7).cast("int").alias("j"), F.lit("same").alias("v")).repartition(5)
    right = spark.createDataFrame([("hot", j, f"r{j}") for j in range(5)] + [("hot", 2, "again")] + [(f"k{i}", i % 7, f"x{i}") for i in range(0, 400, 2)] + [(None, 1, "null"), ("other", 0, "o")], "k string, j int, w string")
    return left, right


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("on", [["k"], ["k", "j"]])
def test_equals_a_plain_join(spark, how, on):
    left, right = sides(spark)
    if len(on) == 1:
        right = right.drop("j")
    want, got = left.join(right, on, how), salted_join(left, right, on, how)
    assert got.columns == want.columns
    pick = lambda df: sorted(((tuple(r)) for r in df.groupBy(*df.columns).count().collect()), key=repr)
    assert pick(got) == pick(want)


def test_no_task_has_much_more_than_the_others(spark):
    """A key with a third of the rows, and null keys: no partition of the join above twice the median."""
    left, right = sides(spark)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    with settings(spark, off):
        def largest(joined):
            rows = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("w")).collect()]
            return max(rows) / median(rows)

        one = right.groupBy("k").agg(F.first("w").alias("w"))
        assert largest(left.join(one, "k", "left")) > 4 and largest(salted_join(left, one, "k", "left")) <= 2
        assert [r["k"] for r in hot_keys(left, ["k"], 1 / 32).collect()] == ["hot"]


def test_edges(spark):
    left, right = sides(spark)
    assert salted_join(left.limit(0), right.drop("j"), "k").count() == 0 and salted_join(left, right.limit(0).drop("j"), "k", "left").count() == 6000
    with pytest.raises(ValueError, match="full"):
        salted_join(left, right, ["k"], "full")
