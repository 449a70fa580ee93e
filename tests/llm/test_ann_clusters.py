import numpy as np

from tidemill.llm import ann


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_small_tight_clusters_and_copies(spark):
    """Unit vectors in tight clusters, far groups of a few and groups of 2 to 19 copies: 20 are found for each query."""
    rng = np.random.default_rng(0)
    n, dims = 6000, 32
    x = unit(unit(rng.normal(size=(30, dims)))[rng.integers(0, 30, n)] + rng.normal(size=(n, dims)) * 0.03)
    order = rng.permutation(n)
    at = 0
    for g in range(18):
        size = g + 2
        x[order[at : at + size]] = unit(rng.normal(size=dims))
        at += size
        size = 8 + g % 8
        x[order[at : at + size]] = unit(unit(rng.normal(size=dims)) + rng.normal(size=(size, dims)) * 0.01)
        at += size
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, every=5, top=20).collect()}
    assert len(got) == 20 * (n // 5)
    hits = 0
    for q in range(0, n, 5):
        score = x @ x[q]
        score[q] = -np.inf
        edge = np.sort(score)[-20]
        hits += sum(score[v] >= edge - 1e-9 for p, v in got if p == q) if q % 100 == 0 else 0
    assert hits / (20 * len(range(0, n, 100))) >= 0.95


def test_unlinked_clusters_are_reached():
    """Centroids of far clusters, more of them than there are links: any list can be reached, and all if few vectors exist."""
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.normal(size=(20, 4)) + 1000 * i for i in range(40)])
    graph = ann.Graph(c)
    sizes = np.ones(len(c), np.int64)
    for i in range(0, len(c), 7):
        assert graph.search(c[i] + 1e-3, 1.16, 8, sizes, 1)[0] == i
    assert len(graph.search(c[0], 1.16, 8, sizes, 10**6)) == len(c)
    assert sizes[graph.search(c[0], 1.16, 8, sizes, 50)].sum() >= 50
