"""Bitmaps against GROUP BY and anti-joins."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.operators import bitmaps


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "k string").repartition(3)


ORDERS = [f"ORD-{i:07d}" for i in range(1, 90_000, 3)]
ODD = ["ORD-1", "ORD-00000012", "ORD-0000001x", "X-0000004", "", None, None, "ORD-12345678", "ORD-0", "ORD-99999999999999999999"]
CASES = {
    "unique": ORDERS, "repeated": ORDERS + ORDERS[5:8] + [ORDERS[-1]] * 3, "odd": ORDERS[:40] + ODD + ["ORD-1"], "only odd": ["a-b", "a-b", "c"], "empty": [], "nulls": [None, None], "two parts": ["OI-1-2", "OI-1-3", "OI-12-3", "OI-1-2"],
}


@pytest.mark.parametrize("named", [bitmaps.NAMED, 0])
def test_repeated_keys(spark, monkeypatch, named):
    monkeypatch.setattr(bitmaps, "NAMED", named)
    got = {r["set"]: tuple(r)[1:] for r in bitmaps.repeated_keys([bitmaps.KeySet(n, frame(spark, ids), "k") for n, ids in CASES.items()]).collect()}
    assert got == {n: (len(ids), len(set(ids) - {None}), sum(c > 1 for c in Counter(ids).values())) for n, ids in CASES.items()}


@pytest.mark.parametrize("child,parent", [("repeated", "unique"), ("odd", "unique"), ("odd", "odd"), ("unique", "odd"), ("only odd", "unique"), ("unique", "empty"), ("empty", "unique"), ("two parts", "two parts"), ("two parts", "nulls")])
def test_orphans(spark, child, parent):
    c, p = CASES[child], CASES[parent]
    if child == "repeated":
        c = c + ["ORD-0000002", "ORD-0000002", "ORD-0099999"]
    got = {r["k"]: r["n"] for r in bitmaps.orphan_rows(frame(spark, c), "k", frame(spark, p)).collect()}
    assert got == {k: n for k, n in Counter(c).items() if k is not None and k not in set(p)}


def test_only_buckets_in_question_are_compared(spark):
    """Numbers in three buckets, one of which has an orphan: no other row reaches the comparison."""
    child = frame(spark, [f"ORD-{i:07d}" for i in range(0, 90_000)])
    parent = frame(spark, [f"ORD-{i:07d}" for i in range(0, 90_000) if i != 40_000])
    form = bitmaps.forms([bitmaps.KeySet("parent", parent, "k")])["parent"]
    own = bitmaps._tagged(bitmaps.KeySet("child", child, "k"), form)
    lost = spark.createDataFrame([("child", 2)], "set string, bucket bigint")
    assert bitmaps._in_question(own, lost).count() == 32_768 and form == bitmaps.Form("ORD-", 7)
    plan = bitmaps._bits(own)._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan and not any(f"hashpartitioning({c}" in plan for c in ("id", "k#", "number"))
    assert [tuple(r) for r in bitmaps.orphan_rows(child, "k", parent).collect()] == [("ORD-0040000", 1)]
    assert own.filter(F.col("number").isNull()).count() == 0
