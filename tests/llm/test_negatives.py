"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest

from tidemill.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every, positives, negs, low, high, scale):
    usable = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((k, i, [math.floor(scale * x) for x in v], label))
    sizes = {}
    for r in usable:
        sizes[len(r[2])] = sizes.get(len(r[2]), 0) + 1
    dims = min(sizes, key=lambda n: (-sizes[n], n))
    usable = [r for r in usable if len(r[2]) == dims]
    out = []
    for a in usable:
        if a[1] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[1], b[3] == a[3]) for b in usable if b[0] != a[0]), key=lambda t: t[:2])
        for s, i, _ in [t for t in scored if t[2]][:positives]:
            hard = [t for t in scored if not t[2] and low * -s <= 100 * -t[0] <= high * -s][:negs]
            out += [(a[1], i, rank, t[1], -s, -t[0]) for rank, t in enumerate(hard, 1)]
    return sorted(out)


def run(spark, rows, every=10, positives=5, negs=10, low=30, high=90, scale=256):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "'x' as pivot", "2 as anchor").repartition(3)
    got = negatives.mine(negatives.whole_vectors(df, scale), every, positives, negs, low, high)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("kind", ["spread", "clustered", "hot", "rare"])
def test_equals_brute_force(spark, kind, monkeypatch):
    """Small blocks and first scans, so that searches widen and certify; ties, one very common vector and rare labels."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "FIRST", 40)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(600, 6))
    labels = rng.integers(0, 4, 600)
    if kind == "clustered":
        x = rng.normal(size=(12, 6))[rng.integers(0, 12, 600)] * 3 + x * 0.2
    if kind == "hot":
        x = np.round(x)  # many ties
        x[100:350] = [1, 0, 2, 0, 0, 1]
    if kind == "rare":
        labels = np.where(np.arange(600) % 97 == 0, 7, labels)  # anchors with fewer positives than asked for
        labels[[200, 300]] = [8, 9]  # and with none
    rows = [(i, v, int(g)) for i, (v, g) in enumerate(zip(x.tolist(), labels, strict=True))]
    want = brute(rows, 10, 5, 10, 30, 90, 256)
    assert len(want) > 500 and run(spark, rows) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.1], 2), (3, [0.4, 0.2], 2), (None, [1.0, 1.0], 1), (4, None, 1), (5, [1.0, 1.0], None), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2), (9, [], 1), (11, [1.0, 2.0, 3.0], 1), (12, [0.0, 0.0], 2), (10, [-1.0, 0.3], 1), (2, [0.5, 0.1], 2), (0, [1.0, 0.5], 1), (-10, [0.7, 0.7], 2)]
    want = brute(rows, 10, 5, 10, 30, 90, 256)
    assert len(want) > 5 and run(spark, rows) == want
    assert run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and run(spark, []) == []


def test_large_components(spark):
    """Beyond 2^53 products are summed in whole numbers, beyond 2^60 they are refused."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-(2**27), 2**27, 4)], int(i % 2)) for i in range(60)]
    assert run(spark, rows, scale=1) == brute(rows, 10, 5, 10, 30, 90, 1)
    with pytest.raises(ValueError, match="beyond"):
        run(spark, [(0, [2.0**40], 1), (1, [2.0**40], 1)], scale=256)


def test_bounds_hold_and_exclude(spark):
    """No row lies outside its block's bounds, and clustered blocks are excluded."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 400 + rng.normal(size=(4000, 8)) * 10).astype(int)
    df = spark.createDataFrame([(i, [int(c) for c in v], i % 3) for i, v in enumerate(x)], "vec_id bigint, v array<bigint>, label bigint")
    index = negatives.Index(df)
    rows = {r["block"]: np.frombuffer(r["vec_id"], np.int64) for r in index.blocks.collect()}
    assert sorted(np.concatenate(list(rows.values())).tolist()) == list(range(4000))
    anchors = x[::400].astype(float)
    least, most = index.bounds(anchors)
    tail = np.sqrt(index.longest - (x.astype(float) ** 2).sum(axis=1))
    for a, q in enumerate(anchors):
        d = np.sqrt(((x - q) ** 2).sum(axis=1) + tail**2)
        for b, block in enumerate(index.block):
            own = d[rows[block]]
            assert least[a, b] <= own.min() and own.max() <= most[a, b]
        kth = np.sort(d)[10]
        assert index.n[least[a] <= kth].sum() < len(x) / 2


def test_nothing_is_broadcast(spark, monkeypatch):
    """Blocks, anchors and windows grow with the table, so the driver never collects one for a join, whatever its size."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    written = negatives.tables.written
    monkeypatch.setattr(negatives.tables, "written", lambda df, name: (plans.append(plan(df)), written(df, name))[1])
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 4).tolist(), i % 3) for i in range(200)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = negatives.mine(negatives.whole_vectors(spark.createDataFrame(rows, SCHEMA), 256), 10, 5, 10, 30, 90)
    assert found.count() > 0 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert any("Join" in p for p in plans) and "Join" in plan(found)
    assert not any("Broadcast" in p for p in [*plans, plan(found)])
