"""Approximate nearest neighbours by balanced posting lists.

Vectors are clustered around centroids fitted on a bounded sample, in two levels where
there are many.  Every vector is put on the list of its nearest centroid, and a boundary
vector also on those of other centroids that are nearly as near, unless one of these lies
nearer to a centroid already chosen than to the vector: such a list is read together
with the other anyway.  Long lists are dealt into parts of bounded size, so no list is a
large task.  A query walks an in-memory graph of the centroids, keeps the lists whose
distance is within a ratio of the nearest ones' mean, and is compared with all vectors on them.
Where near lists hold too few vectors, the walk goes on until they hold several times as
many as are asked for.

The ratio that finds a stated share of neighbours depends on how the vectors lie, so it
is measured on the sample: tightly clustered vectors get by with few lists.

Largest inner product becomes smallest distance by one more coordinate, which gives
all vectors the length of the longest; queries have 0 there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: Rows that the centroids and the ratio are fitted on, at most about; a centroid needs SAMPLE_PER_LIST of them.
SAMPLE, SAMPLE_PER_LIST = 131_072, 8
#: Vectors on a list, about, as long as the sample has rows for so many centroids (up to 524,288 rows).
ROWS_PER_LIST = 32
#: Centroids that are fitted at once; with more, clusters of clusters are.
FLAT = 1024
#: A vector is also listed at centroids up to this many times as far as its nearest, ...
BOUNDARY = 1.2
#: ... on so many lists at most.
COPIES = 4
#: Coarse clusters in which a vector looks for its nearest centroids.
BEAM = 12
#: Share of the sample's neighbours that the ratio finds, measured with so many queries.
RECALL, TRIALS = 0.94, 250
#: Nearest lists whose mean distance the ratio refers to; the distance of one alone varies too much.
NEAREST = 16
#: Nearest centroids whose links are walked however far they are.  The ratio is measured on all centroids, and with a
#: narrow walk some within it are never reached.
WIDTH = 32
#: A query reads lists that hold this many times as many vectors as are asked for, however far they are.
AMPLE = 8
#: Vectors in one part of a list, about.
PART = 4096
_PARTS, _STRIDE = 1 << 20, 7919


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes their length ``longest``."""
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))[:, None]])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds in which a cluster of over twice the mean size gives its outer half to the smallest one."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for r in range(rounds):
        d = distances(x, c)
        near = d.argmin(axis=1)
        size = np.bincount(near, minlength=k)
        for big, small in zip(np.argsort(-size)[: k // 4], np.argsort(size)[: k // 4], strict=True):
            if r < rounds - 3 and size[big] > 2 * len(x) / k and size[small] < len(x) / k / 2:
                own = np.flatnonzero(near == big)
                near[own[np.argsort(d[own, big])[len(own) // 2 :]]] = small
        size = np.bincount(near, minlength=k)
        order, some = np.argsort(near, kind="stable"), size > 0
        sums = np.zeros_like(c)
        sums[some] = np.add.reduceat(x[order], (np.cumsum(size) - size)[some])
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


class Centroids:
    """Centroids with the coarse clusters that they lie in; flat ones have one such cluster each."""

    def __init__(self, sample: np.ndarray, k: int):
        if k <= FLAT:
            self.c = self.coarse = fit_centroids(sample, k)
            self.first = np.arange(len(self.c) + 1)
            return
        self.coarse = fit_centroids(sample, int(np.sqrt(k)))
        near = np.concatenate([distances(sample[i : i + 4096], self.coarse).argmin(axis=1) for i in range(0, len(sample), 4096)])
        own = [sample[near == i] for i in range(len(self.coarse))]
        fine = [fit_centroids(x, max(1, round(len(x) * k / len(sample))), rounds=6) if len(x) else self.coarse[i : i + 1] for i, x in enumerate(own)]
        self.c = np.concatenate(fine)
        self.first = np.cumsum([0, *map(len, fine)])

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the ``n`` nearest of each vector, nearest first; with two levels those of near clusters."""
        if len(self.coarse) == len(self.c):
            d = distances(x, self.c)
            near = np.argpartition(d, n, axis=1)[:, :n] if n < len(self.c) else np.broadcast_to(np.arange(len(self.c)), d.shape)
            there = np.take_along_axis(d, near, axis=1)
            order = np.argsort(there, axis=1, kind="stable")
            return np.take_along_axis(near, order, axis=1), np.sqrt(np.take_along_axis(there, order, axis=1))
        # Each coarse cluster is compared with the vectors that it is near to.
        close = np.argsort(distances(x, self.coarse), axis=1, kind="stable")[:, :BEAM]
        at, far = np.zeros((len(x), BEAM * n), np.int64), np.full((len(x), BEAM * n), np.inf)
        for g in np.unique(close):
            rows, column = np.nonzero(close == g)
            d = distances(x[rows], self.c[self.first[g] : self.first[g + 1]])
            best = np.argsort(d, axis=1, kind="stable")[:, :n]
            for j in range(best.shape[1]):
                at[rows, column * n + j] = self.first[g] + best[:, j]
                far[rows, column * n + j] = d[np.arange(len(rows)), best[:, j]]
        order = np.argsort(far, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(at, order, axis=1), np.sqrt(np.take_along_axis(far, order, axis=1))

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, is it the nearest) of the lists that each vector is put on."""
        near, d = self.nearest(x, 2 * COPIES)
        chosen = np.zeros(near.shape, bool)
        chosen[:, 0] = True
        for j in range(1, near.shape[1]):
            use = (d[:, j] <= BOUNDARY * d[:, 0]) & (chosen.sum(axis=1) < COPIES) & np.isfinite(d[:, j]) & (d[:, 0] > 0)
            for i in range(j):
                apart = self.c[near[:, i]] - self.c[near[:, j]]
                use &= ~chosen[:, i] | ((apart * apart).sum(axis=1) > d[:, j] ** 2)
            chosen[:, j] = use
        row, copy = np.nonzero(chosen)
        return row, near[row, copy], copy == 0


class Graph:
    """Neighbour links between centroids, walked outwards from a spread of them."""

    def __init__(self, centroids: np.ndarray, links: int = 16):
        self.c = centroids
        k = len(centroids)
        links = min(links, k - 1)
        near = np.zeros((k, links), np.int64)
        for i in range(0, k, 1024):
            d = distances(centroids[i : i + 1024], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 1024] = np.argsort(d, axis=1, kind="stable")[:, :links]
        a, b = np.repeat(np.arange(k), links), near.ravel()
        pairs = np.unique(np.concatenate([a * k + b, b * k + a])) if k else np.zeros(0, np.int64)
        self.to = (pairs % max(1, k)).astype(np.int32)
        self.first = np.searchsorted(pairs // max(1, k), np.arange(k + 1))
        # Walks start at a spread of centroids, and at one of every part that no link leads to.
        entries = np.linspace(0, max(0, k - 1), min(k, 24)).astype(np.int64)
        reached = np.zeros(k, bool)
        self.entries = entries
        for start in [entries, *[np.array([i]) for i in range(k)]]:
            if start is entries or not reached[start[0]]:
                todo = start
                if start is not entries:
                    self.entries = np.append(self.entries, start)
                while len(todo):
                    reached[todo] = True
                    todo = self._around(todo)
                    todo = todo[~reached[todo]]
        self.entries = np.unique(self.entries)

    def _around(self, nodes: np.ndarray) -> np.ndarray:
        n = self.first[nodes + 1] - self.first[nodes]
        return np.unique(self.to[np.repeat(self.first[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])

    def search(self, q: np.ndarray, ratio: float, width: int, sizes: np.ndarray, enough: int) -> np.ndarray:
        """Centroids within ``ratio`` times the mean distance of the nearest, and on until they have several times ``enough`` vectors by ``sizes``."""
        if not len(self.c):
            return np.zeros(0, np.int64)
        seen, walked = np.zeros(len(self.c), bool), np.zeros(len(self.c), bool)
        nodes, d = np.zeros(0, np.int64), np.zeros(0)
        new = self.entries
        while True:
            seen[new] = True
            away = self.c[new] - q
            nodes, d = np.append(nodes, new), np.append(d, np.sqrt((away * away).sum(axis=1)))
            order = np.argsort(d, kind="stable")
            nodes, d = nodes[order], d[order]
            many = np.searchsorted(np.cumsum(sizes[nodes]), AMPLE * enough)
            most = max(d[:NEAREST].mean() * ratio, d[many]) if many < len(d) else np.inf
            # The nearest ``width`` are walked whatever their distance, so that gaps are crossed.
            todo = nodes[(d <= most) | (np.arange(len(d)) < width)]
            todo = todo[~walked[todo]]
            walked[todo] = True
            new = self._around(todo) if len(todo) else todo
            new = new[~seen[new]]
            if not len(todo):
                return nodes[d <= most]


def fit_ratio(sample: np.ndarray, queries: np.ndarray, centroids: Centroids, near: int, seed: int = 5) -> float:
    """The ratio at which lists hold the share RECALL of the ``near`` nearest in the sample, over rows of it as queries."""
    rng = np.random.default_rng(seed)
    trial = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    near = min(near, len(sample) - 1)
    if near < 1:
        return 1.0
    needed = []
    for i in trial:
        score = sample @ queries[i]  # the last coordinate of a query is 0
        score[i] = -np.inf
        best = np.argpartition(-score, near - 1)[:near]
        row, list_, _ = centroids.lists(sample[best])
        away = centroids.c - queries[i]
        d = np.sqrt((away * away).sum(axis=1))
        at = np.full(near, np.inf)
        np.minimum.at(at, row, d[list_])
        needed.append(at / max(np.sort(d)[:NEAREST].mean(), 1e-300))
    return float(np.quantile(np.concatenate(needed), RECALL))


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    e = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    e = e.filter("vec_id is not null and v is not null").filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return e


def search(embeddings: DataFrame, every: int = 20, top: int = 20, ratio: float | None = None) -> DataFrame:
    """The ``top`` nearest found for every row whose vec_id is divisible by ``every``.

    Columns query_id, rank, vec_id, score: the inner product in double precision on the
    original vectors, nearest first, ties to the smaller vec_id; a query's own vec_id is
    no candidate.  Vectors that are null, all zero, or hold a null, NaN or infinite
    component take no part, nor do rows without vec_id, nor vectors of another length
    than the most common one (the shorter of two equally common).  Of rows that repeat
    a vec_id the nearest counts.  An empty table gives no rows.  ``ratio``: of the lists
    that are read; None: fitted on the sample.
    """
    spark = embeddings.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    all_rows = usable(embeddings)
    lengths = all_rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims, rows, longest = lengths["n"], lengths["rows"], float(np.sqrt(lengths["longest"]))
    all_rows = all_rows.filter(F.size("v") == dims)

    wanted = max(1, rows // ROWS_PER_LIST)
    share = min(1.0, min(SAMPLE, 20 * SAMPLE_PER_LIST * wanted) / rows)
    drawn = all_rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "v").toArrow()
    plain = matrix(drawn.column("v"))[np.argsort(drawn.column("vec_id").to_numpy(), kind="stable")] if drawn.num_rows else np.zeros((1, dims))
    sample = lifted(plain, longest)
    centroids = Centroids(sample, min(wanted, max(1, len(sample) // SAMPLE_PER_LIST)))
    k = len(centroids.c)
    graph = Graph(centroids.c)
    if ratio is None:
        # What is the top-th of all rows is the near-th of the sample.
        ratio = fit_ratio(sample, np.hstack([plain, np.zeros((len(plain), 1))]), centroids, max(1, round(top * share)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, list_, own = centroids.lists(lifted(matrix(part.column("v")), longest))
                yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row)), pa.array(own)], names=["list", "vec_id", "v", "own"])

    postings = tables.written(all_rows.mapInArrow(assign, "list int, vec_id bigint, v array<double>, own boolean"), "postings")
    # One number for each list: how long it is, and how many vec_ids have it as their nearest, each counted once.
    sizes, distinct = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    for r in postings.filter("own").groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        distinct[r["list"]] = r["n"]
    parts = -(-sizes // PART)
    groups = tables.partitions(spark)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and group of lists that it has to read: the parts there, and its vector."""
        for batch in batches:
            x = np.hstack([matrix(batch.column("v")), np.zeros((batch.num_rows, 1))]) if batch.num_rows else np.zeros((0, dims + 1))
            row, group, cuts, slots = [], [], [0], [np.zeros(0, np.int64)]
            for i in range(len(x)):
                read = graph.search(x[i], ratio, WIDTH, distinct, top + 1)
                n = parts[read]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                list_ = np.repeat(read, n)
                own = (list_ * _STRIDE + part) % groups
                order = np.argsort(own, kind="stable")
                there, counts = np.unique(own, return_counts=True)
                row += [i] * len(there)
                group += there.tolist()
                cuts += (cuts[-1] + np.cumsum(counts)).tolist()
                slots.append((list_ * _PARTS + part)[order])
            at = pa.array(row, pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(slots), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), lists, batch.column("vec_id").take(at), batch.column("v").take(at)], names=["grp", "slots", "vec_id", "v"])

    queries = all_rows.filter(F.col("vec_id") % every == 0).mapInArrow(route, "grp bigint, slots array<bigint>, vec_id bigint, v array<double>")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings by the group and the part that they belong to."""
        for batch in batches:
            list_, vec = batch.column("list").to_numpy().astype(np.int64), batch.column("vec_id").to_numpy()
            spread = (vec.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (spread % parts[list_].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((list_ * _STRIDE + part) % groups), pa.array(list_ * _PARTS + part), batch.column("vec_id"), batch.column("v")], names=["grp", "slot", "vec_id", "v"])

    dealt = postings.select("list", "vec_id", "v").mapInArrow(deal, "grp bigint, slot bigint, vec_id bigint, v array<double>")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The nearest of each query among the lists of one group."""
        slots = left.column("slots").combine_chunks() if left.num_rows else pa.array([], pa.list_(pa.int64()))
        readers = np.repeat(np.arange(left.num_rows), np.diff(slots.offsets.to_numpy()))
        query, vec, score = nearest_on_lists(matrix(left.column("v")), left.column("vec_id").to_numpy(), readers, slots.flatten().to_numpy(), matrix(right.column("v")), right.column("vec_id").to_numpy(), right.column("slot").to_numpy(), top)
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        cuts = pa.array(np.append(first, len(query)), pa.int32())
        return pa.table({"query_id": query[first], "ids": pa.ListArray.from_arrays(cuts, pa.array(vec)), "scores": pa.ListArray.from_arrays(cuts, pa.array(score))})

    # A row for each query and group; a query has at most ``top`` vectors of each group.
    found = queries.groupBy("grp").cogroup(dealt.groupBy("grp")).applyInArrow(compare, "query_id bigint, ids array<bigint>, scores array<double>")
    by_nearness = F.zip_with("ids", "scores", lambda i, s: F.struct((F.lit(0.0) - s).alias("far"), i.alias("vec_id")))
    merged = found.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list(by_nearness))).alias("all"))
    # A vec_id on several lists, or of several rows, counts once, where it is nearest.
    merged = merged.withColumn("ids", F.transform("all", lambda x: x["vec_id"])).withColumn("first", F.slice(F.array_distinct("ids"), 1, top))
    scored = F.transform("first", lambda i: F.struct(i.alias("vec_id"), (F.lit(0.0) - F.element_at("all", F.array_position("ids", i).cast("int"))["far"]).alias("score")))
    ranked = merged.select("query_id", F.posexplode(scored).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def nearest_on_lists(q: np.ndarray, qid: np.ndarray, readers: np.ndarray, wanted: np.ndarray, x: np.ndarray, xid: np.ndarray, slot: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec_id, score) of the ``top`` nearest of each query among the vectors of the slots that it reads.

    Slot by slot all readers are compared at once, and what does not reach a reader's
    top-th so far is dropped.  The product's last bits depend on its shape, so scores that
    may tie are kept, and measured again one pair at a time at the end.
    """
    if not len(wanted) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    order = np.argsort(slot, kind="stable")
    held = slot[order]
    by_slot = np.argsort(wanted, kind="stable")
    readers, wanted = readers[by_slot], wanted[by_slot]
    least = np.full(len(q), -np.inf)
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    n = 0

    def shrink() -> None:
        """Only what may still be among the first, each vec_id once for a query."""
        nonlocal kept, n
        r, c, s = (np.concatenate([p[j] for p in kept]) for j in range(3))
        by = np.lexsort([-s, xid[c], r])
        r, c, s = r[by], c[by], s[by]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (xid[c[1:]] != xid[c[:-1]])
        r, c, s = r[new], c[new], s[new]
        by = np.lexsort([-s, r])
        r, c, s = r[by], c[by], s[by]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        edge = place == top - 1
        least[r[edge]] = s[edge]
        use = s >= least[r] - 1e-9 * np.maximum(1.0, np.abs(least[r]))
        kept = [(r[use], c[use], s[use])]
        n = int(use.sum())

    distinct, starts = np.unique(wanted, return_index=True)
    for w, i, j in zip(distinct, starts, np.append(starts[1:], len(wanted)), strict=True):
        own = order[np.searchsorted(held, w) : np.searchsorted(held, w, "right")]
        own = _first_of_equal(x[own], xid[own], own, top + 1)
        for at in range(i, j if len(own) else i, 512):
            some = readers[at : min(j, at + 512)]
            s = q[some] @ x[own].T
            r, c = np.nonzero((s >= (least[some] - 1e-9 * np.maximum(1.0, np.abs(least[some])))[:, None]) & (qid[some][:, None] != xid[own][None, :]))
            kept.append((some[r], own[c], s[r, c]))
            n += len(r)
            if n > 2_000_000 or n > 8 * top * len(q):
                shrink()
    shrink()
    r, c, _ = kept[0]
    exact = np.concatenate([np.zeros(0), *[(x[c[i : i + 65536]] * q[r[i : i + 65536]]).sum(axis=1) for i in range(0, len(r), 65536)]])
    # Of rows that repeat a vec_id the nearest counts.
    by = np.lexsort([-exact, xid[c], r])
    r, c, exact = r[by], c[by], exact[by]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (xid[c[1:]] != xid[c[:-1]])
    r, c, exact = r[new], c[new], exact[new]
    by = np.lexsort([xid[c], -exact, r])
    r, c, exact = r[by], c[by], exact[by]
    use = np.arange(len(r)) - np.searchsorted(r, r) < top
    return qid[r[use]], xid[c[use]], exact[use]


def _first_of_equal(y: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of equal vectors only the ``n`` smallest ids: ties go to them, so no query can have another."""
    if len(at) <= n:
        return at
    key = np.ascontiguousarray(y + 0.0).view([("", np.void, y.shape[1] * 8)]).ravel()
    _, which = np.unique(key, return_inverse=True)
    by = np.lexsort([ids, which])
    place = np.arange(len(by)) - np.searchsorted(which[by], which[by])
    return at[np.sort(by[place < n])]
