"""Parts of the search against plain forms, and how much it prunes."""

import numpy as np
import pytest

from tidemill.llm import ann


def test_lists_follow_the_rule():
    """The nearest centroid, and others near enough that no chosen one is nearer to them than the vector."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    found = ann.Centroids(x, 40)
    row, list_, own = found.lists(x[:60])
    for i in range(60):
        d = np.sqrt(((found.c - x[i]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")[: 2 * ann.COPIES]
        chosen = [order[0]]
        for c in order[1:]:
            if d[c] <= ann.BOUNDARY * d[order[0]] and d[order[0]] > 0 and len(chosen) < ann.COPIES and all(np.sqrt(((found.c[c] - found.c[b]) ** 2).sum()) > d[c] for b in chosen):
                chosen.append(c)
        assert list_[row == i].tolist() == chosen and list_[(row == i) & own].tolist() == [order[0]]


def test_two_levels():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 5)) * 0.1 + rng.normal(size=5) * 5 for _ in range(60)])
    found = ann.Centroids(x, 1500)
    assert 1000 < len(found.c) <= 1600 and len(found.coarse) < 50
    near, d = found.nearest(x[:500], 3)
    exact = np.sqrt(ann.distances(x[:500], found.c))
    assert (near[:, 0] == exact.argmin(axis=1)).mean() > 0.98 and np.allclose(d[:, 0], exact[np.arange(500), near[:, 0]])


def test_graph_reaches_what_a_scan_finds():
    rng = np.random.default_rng(4)
    c = np.concatenate([rng.normal(size=(40, 4)) + 30 * i for i in range(5)])  # far clusters, no link between them by distance
    graph, sizes = ann.Graph(c), rng.integers(0, 40, len(c))
    for _ in range(30):
        q = c[rng.integers(len(c))] + rng.normal(size=4) * 0.2
        d = np.sqrt(((c - q) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        many = np.searchsorted(np.cumsum(sizes[order]), ann.AMPLE * 5)
        most = max(np.sort(d)[: ann.NEAREST].mean() * 1.1, d[order[many]])
        assert set(graph.search(q, 1.1, 8, sizes, 5)) == set(np.flatnonzero(d <= most))


def test_compare_is_exact_on_what_it_reads():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-2, 3, (300, 3)).astype(float), np.ones((400, 3))])  # many ties, one vector very often
    xid, slot = rng.permutation(700).astype(np.int64), rng.integers(0, 12, 700)
    q, qid = x[:50], xid[:50]
    reads = [np.sort(rng.choice(12, rng.integers(1, 8), replace=False)) for _ in range(50)]
    query, vec, score = ann.nearest_on_lists(q, qid, np.repeat(np.arange(50), [len(r) for r in reads]), np.concatenate(reads), x, xid, slot, 20)
    got = {}
    for a, b, s in zip(query, vec, score, strict=True):
        got.setdefault(a, []).append((-s, b))
    for i in range(50):
        own = sorted((-float((q[i] * x[j]).sum()), xid[j]) for j in range(700) if slot[j] in reads[i] and xid[j] != qid[i])[:20]
        assert sorted(got.get(qid[i], [])) == own


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_and_pruning(spark, clustered):
    """Recall over all queries, and that lists read hold a small part of clustered vectors."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 16))
    if clustered:
        x = rng.normal(size=(100, 16))[rng.integers(0, 100, 20_000)] * 3 + x * 0.3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(df, every=40, top=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in range(0, 20_000, 40):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[i] & set(np.argpartition(-s, 10)[:10].tolist()))
        assert len(got[i]) == 10
    assert hits / (500 * 10) >= 0.93
    longest = float(np.sqrt((x * x).sum(axis=1).max()))
    found = ann.Centroids(ann.lifted(x, longest), 20_000 // ann.ROWS_PER_LIST)
    ratio = ann.fit_ratio(ann.lifted(x, longest), np.hstack([x, np.zeros((len(x), 1))]), found, 10)
    row, list_, _ = found.lists(ann.lifted(x, longest))
    sizes, graph = np.bincount(list_, minlength=len(found.c)), ann.Graph(found.c)
    read = [sizes[graph.search(np.append(x[i], 0), ratio, ann.WIDTH, sizes, 11)].sum() / len(x) for i in range(0, 20_000, 400)]
    assert np.mean(read) < (0.25 if clustered else 0.6) and len(row) < 2.5 * len(x)


def test_repeated_ids_and_odd_rows(spark):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.9, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 1.0]), (8, [0.9, 3.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as rank", "2 as list"), every=20, top=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 1, 0.9), (20, 2, 8, 0.9)]
    assert ann.search(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0
