"""Hard negatives by one-dimensional distance keys.

Vectors of whole numbers get one more coordinate that gives all of them the length of the
longest; an anchor has 0 there.  Then the squared distance is |anchor|^2 + longest^2 - 2 *
inner product, so largest products are smallest distances, and a window of products is an
annulus around the anchor.

Every vector is stored under its nearest pivot and its distance from it, sorted by (pivot,
distance), and cut into blocks: contiguous intervals of that key.  By the triangle
inequality a block whose distances from its pivot lie in [lo, hi] holds nothing nearer to
an anchor than its own distance from the pivot is to that interval.  A search scans the
blocks whose bound is within a radius, starting with as many as hold a first number of
rows, and widens the radius until it reaches the k-th best found; what was not scanned
cannot be among the first k then.  The distance of the k-th best is itself a radius that
certifies, so two scans do for an anchor that finds k in the first; with fewer than k the
number of rows grows eightfold until all is scanned.

Each anchor looks for its positives in this way and then, for all of them together, for the
nearest rows of other labels in their windows; a window's outer end is the widest radius.

Scans are joins of blocks with anchors packed by block, so a task holds one block and a few
hundred anchors at a time, whatever the number of either; a vector that a third of the rows
repeat fills many blocks like others.  What reaches the driver is the directory of blocks
(at most DIRECTORY, and one for each pivot and partition), and a bounded sample for pivots.

Products are exact: in double precision below 2^53, else in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables
from .ann import distances, fit_centroids

#: Rows that pivots are fitted on, pivots, rows in a block at least, blocks in the directory, about.
SAMPLE, PIVOTS, BLOCK, DIRECTORY = 16_384, 64, 1024, 65_536
#: Rows that a search scans first, and the growth of that where it found too few.
FIRST, GROWTH = 4096, 8
#: Anchors in a chunk, and bounds of blocks worked out at once.
CHUNK, BOUNDS = 512, 4_000_000
_PART = 4096
_NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
_BLOCKS = "block bigint, pivot int, lo double, hi double, n int, row binary, vec_id binary, label binary, vectors binary"
_ANCHOR = ("anchor", "anchor_id", "anchor_label", "vector")


def whole_vectors(embeddings: DataFrame, scale: int, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, each component floor(scale * x)."""
    e = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.expr(f"try_cast(`{label}` as bigint)").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    e = e.filter("vec_id is not null and label is not null and v is not null").filter(F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))
    return e.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)))


class Index:
    """Blocks of rows by (pivot, distance), and their directory."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        sizes = vectors.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"))
        first = sizes.orderBy(F.desc("rows"), "n").first()
        self.rows = first["rows"] if first else 0
        if not self.rows:
            return
        self.dims, most = first["n"], int(first["most"])
        if self.dims * most * most >= 1 << 60:
            raise ValueError(f"components up to {most} have inner products beyond 64 bits")
        self.exact = np.float64 if self.dims * most * most < 1 << 53 else np.int64
        kind = self.kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        vectors = vectors.filter(F.size("v") == self.dims)
        self.longest = longest = vectors.agg(F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x))).first()[0]
        share = min(1.0, SAMPLE / self.rows)
        drawn = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "v").toArrow()
        order = np.argsort(drawn.column("vec_id").to_numpy(), kind="stable")
        plain = _matrix(drawn.column("v"))[order] if drawn.num_rows else np.zeros((1, self.dims))
        pivots = self.pivots = fit_centroids(_lifted(plain, longest), max(1, min(PIVOTS, len(plain) // 32)))

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"))
                d = distances(_lifted(x, longest), pivots)
                near = d.argmin(axis=1)
                far = np.sqrt(d[np.arange(len(x)), near])
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far), *(batch.column(c) for c in ("row", "vec_id", "label")), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["pivot", "distance", "row", "vec_id", "label", "vector"])

        numbered = vectors.withColumn("row", F.monotonically_increasing_id())
        keyed = tables.written(numbered.mapInArrow(key, "pivot int, distance double, row bigint, vec_id bigint, label bigint, vector binary"), "distance-keys")
        size = max(BLOCK, -(-self.rows // DIRECTORY))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks of consecutive rows of one pivot."""
            number = TaskContext.get().partitionId() << 32
            held: list[pa.Table] = []
            now = None

            def block() -> pa.RecordBatch:
                nonlocal number, held
                t = pa.concat_tables(held)
                number, held = number + 1, []
                far = t.column("distance").to_numpy()
                cells = [t.column(c).to_numpy().tobytes() for c in ("row", "vec_id", "label")] + [b"".join(t.column("vector").to_pylist())]
                return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([now], pa.int32()), pa.array([far.min()]), pa.array([far.max()]), pa.array([len(far)], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=[f.split()[0] for f in _BLOCKS.split(", ")])

            for batch in batches:
                pivot = batch.column("pivot").to_numpy()
                at = 0
                while at < len(pivot):
                    if held and (now != pivot[at] or sum(map(len, held)) >= size):
                        yield block()
                    now = pivot[at]
                    n = min(int(np.searchsorted(pivot[at:], now, "right")), size - sum(map(len, held)))
                    held.append(pa.Table.from_batches([batch.slice(at, n)]))
                    at += n
            if held:
                yield block()

        ordered = keyed.repartitionByRange(tables.partitions(spark), "pivot", "distance", "row").sortWithinPartitions("pivot", "distance", "row")
        self.blocks = tables.written(ordered.mapInArrow(pack, _BLOCKS), "distance-blocks")
        tables.remove(keyed)
        stats = self.blocks.select("block", "pivot", "lo", "hi", "n").toArrow()
        by = np.argsort(stats.column("block").to_numpy())
        self.block, self.pivot, self.lo, self.hi, self.n = (stats.column(c).to_numpy()[by] for c in ("block", "pivot", "lo", "hi", "n"))
        #: Distances are worked out in double precision; bounds give way by this much.
        self.slack = 1e-6 + 1e-9 * float(np.sqrt(longest) + np.sqrt((pivots * pivots).sum(axis=1).max()))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) distance of each anchor from anything in each block."""
        d = np.sqrt(distances(np.hstack([anchors, np.zeros((len(anchors), 1))]), self.pivots))[:, self.pivot]
        return np.maximum(np.maximum(d - self.hi, self.lo - d), 0) - self.slack, d + self.hi + self.slack

    def slice(self) -> int:
        return max(16, min(CHUNK, BOUNDS // max(1, len(self.block))))

    def vectors(self, cells: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(cells), self.kind).reshape(len(cells), self.dims)

    def anchors(self, every: int) -> DataFrame:
        """(anchor, anchor_id, anchor_label, vector, square) of the rows whose vec_id is divisible by ``every``, near ones together."""
        kind, dims = self.kind, self.dims

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cells in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "label", "vectors")), strict=True):
                    row, ids, label = (np.frombuffer(c, np.int64) for c in cells[:3])
                    use = ids % every == 0
                    x = np.frombuffer(cells[3], kind).reshape(-1, dims)[use]
                    square = (x.astype(np.int64) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(row[use]), pa.array(ids[use]), pa.array(label[use]), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(square)], names=[*_ANCHOR, "square"])

        return self.blocks.mapInArrow(unpack, "anchor bigint, anchor_id bigint, anchor_label bigint, vector binary, square bigint")

    def with_radius(self, anchors: DataFrame, rows: int) -> DataFrame:
        """All columns and ``radius``: within it lie the bounds of so many blocks that they hold ``rows`` rows; infinite if no fewer than all do."""
        index = self._closure()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, step = index.vectors(batch.column("vector").to_pylist()), index.slice()
                found = [np.zeros(0)]
                for at in range(0, len(x), step):
                    least, _ = index.bounds(x[at : at + step].astype(np.float64))
                    order = np.argsort(least, axis=1, kind="stable")
                    held = np.cumsum(index.n[order], axis=1)
                    last = (held < rows).sum(axis=1)
                    whole = last >= len(index.n) - 1
                    found.append(np.where(whole, np.inf, np.take_along_axis(least, np.take_along_axis(order, np.minimum(last, len(index.n) - 1)[:, None], axis=1), axis=1)[:, 0]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*batch.schema.names, "radius"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
        return anchors.mapInArrow(work, f"{fields}, radius double")

    def scan(self, state: DataFrame, top: int) -> DataFrame:
        """Candidates of each anchor in the blocks with bounds beyond ``seen`` and within ``radius``.

        ``state`` also has ``windows``: for each window of an anchor its number, its least
        and greatest product, and 1 if rows of the anchor's own label are looked for, 0 if
        others are.  Of each block at most the ``top`` nearest of each window are returned:
        anchor, window, vec_id, row, score.
        """
        index = self._closure()
        anchored = state.select(*_ANCHOR, "seen", "radius", "square", F.flatten("windows").alias("windows"), F.size("windows").alias("size"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each block and chunk of anchors that have to scan it."""
            for batch in batches:
                step = index.slice()
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    x = index.vectors(part.column("vector").to_pylist())
                    row, ids, label, size, square = (part.column(c).to_numpy() for c in ("anchor", "anchor_id", "anchor_label", "size", "square"))
                    flat = part.column("windows").flatten().to_numpy()
                    windows = np.full((len(row), max(1, size.max(initial=0)), 4), -1, np.int64)
                    windows[np.arange(windows.shape[1]) < size[:, None]] = flat.reshape(-1, 4)
                    # Blocks all of whose rows are nearer than every window's inner end hold nothing.
                    highest = np.where(windows[:, :, 0] >= 0, windows[:, :, 2], np.iinfo(np.int64).min).max(axis=1)
                    inner = np.sqrt(np.maximum(square.astype(float) + index.longest - 2.0 * highest, 0))
                    least, most = index.bounds(x.astype(np.float64))
                    use = (least > part.column("seen").to_numpy()[:, None]) & (least <= part.column("radius").to_numpy()[:, None]) & (most >= inner[:, None])
                    for b in np.flatnonzero(use.any(axis=0)):
                        who = np.flatnonzero(use[:, b])
                        cells = [row[who], ids[who], label[who], windows[who], x[who]]
                        yield pa.RecordBatch.from_arrays([pa.array([index.block[b]]), pa.array([len(who)], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells)], names=["block", "anchors", "a_row", "a_id", "a_label", "a_windows", "a_vectors"])

        routed = anchored.mapInArrow(route, "block bigint, anchors int, a_row binary, a_id binary, a_label binary, a_windows binary, a_vectors binary")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    a_row, a_label = (np.frombuffer(r[c], np.int64) for c in ("a_row", "a_label"))
                    windows = np.frombuffer(r["a_windows"], np.int64).reshape(len(a_row), -1, 4)
                    q = np.frombuffer(r["a_vectors"], index.kind).reshape(len(a_row), index.dims).astype(index.exact)
                    row, ids, label = (np.frombuffer(r[c], np.int64) for c in ("row", "vec_id", "label"))
                    x = np.frombuffer(r["vectors"], index.kind).reshape(len(row), index.dims)
                    order = np.lexsort([row, ids])
                    for at in range(0, len(order), _PART):
                        some = order[at : at + _PART]
                        who, window, what, score = nearest_in_windows(q, a_row, a_label, windows, x[some].astype(index.exact), row[some], label[some], top)
                        if len(who):
                            yield pa.RecordBatch.from_arrays([pa.array(a_row[who]), pa.array(window), pa.array(ids[some[what]]), pa.array(row[some[what]]), pa.array(score)], names=["anchor", "window", "vec_id", "row", "score"])

        joined = routed.join(self.blocks.select("block", "row", "vec_id", "label", "vectors"), "block")
        return joined.mapInArrow(compare, "anchor bigint, window bigint, vec_id bigint, row bigint, score bigint")

    def _closure(self) -> "Index":
        """What tasks need of the index: the directory and the pivots, without DataFrames."""
        index = object.__new__(Index)
        index.__dict__ = {k: v for k, v in self.__dict__.items() if not isinstance(v, DataFrame)}
        return index


def nearest_in_windows(q: np.ndarray, q_row: np.ndarray, q_label: np.ndarray, windows: np.ndarray, x: np.ndarray, row: np.ndarray, label: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, window, row's place, score) of the ``top`` best in each window, rows given by ascending id; never the anchor's own row."""
    scores = (q @ x.T).astype(np.int64)
    same, other = q_label[:, None] == label[None, :], q_row[:, None] != row[None, :]
    out = [(np.zeros(0, np.int64),) * 4]
    none = np.iinfo(np.int64).min
    for j in range(windows.shape[1]):
        number, low, high, own = (windows[:, j, i] for i in range(4))
        use = other & (same == (own == 1)[:, None]) & (scores >= low[:, None]) & (scores <= high[:, None]) & (number >= 0)[:, None]
        if not use.any():
            continue
        if len(row) > top:
            held = np.where(use, scores, none)
            edge = np.partition(held, len(row) - top, axis=1)[:, len(row) - top][:, None]
            # Of ties at the edge the first come first, and never more than ``top``.
            tie = use & (scores == edge)
            use = (use & (scores > edge)) | (tie & (np.cumsum(tie, axis=1) <= top))
        r, c = np.nonzero(use)
        out.append((r, number[r], c, scores[r, c]))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _lifted(x: np.ndarray, longest: int) -> np.ndarray:
    square = (x.astype(np.int64) ** 2).sum(axis=1)
    return np.hstack([x.astype(np.float64), np.sqrt(np.maximum(longest - square, 0).astype(np.float64))[:, None]])


def _best(candidates: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return candidates.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """The hardest negatives for every anchor (vec_id divisible by ``every``) and each of its positives.

    ``vectors``: vec_id, label, v of whole numbers (``whole_vectors``).  Score: inner product
    with the anchor; higher first, ties by smaller vec_id.  Positives: an anchor's first
    ``positives`` other rows of its label.  Negatives: the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * score <= high * positive_score.  Returns
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without vec_id, label or vector, with a null or non-finite component or an empty
    vector take no part, nor do vectors of another length than the most common one (the
    shorter of two equally common).  Rows that repeat a vec_id count each on its own, as
    anchors, positives and negatives.  An empty table gives no rows.  Products of 2^60 and
    more are an error.

    No join is a broadcast: blocks, anchors and windows all grow with the table, and the
    driver would hold each of those that its files' size lets pass, several times as large.
    """
    with tables.settings(vectors.sparkSession, _NO_BROADCAST):
        return _mine(vectors, every, positives, negatives, low, high)


def _mine(vectors: DataFrame, every: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = vectors.sparkSession
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    index = Index(vectors)
    if not index.rows:
        return spark.createDataFrame([], result)
    anchors = tables.written(index.anchors(every), "anchors")

    def distance(score) -> F.Column:
        return F.sqrt(F.greatest(F.col("square") + F.lit(index.longest) - 2 * score, F.lit(0)).cast("double"))

    def window(number, lowest, highest, own_label: int) -> F.Column:
        return F.array(*[c.cast("bigint") for c in (number, lowest, highest, F.lit(own_label))])

    # Positives: one window, all products, own label.
    least_of_all, most_of_all = F.lit(-(1 << 61)), F.lit(1 << 61)
    own = F.array(window(F.lit(0), least_of_all, most_of_all, 1))
    state = tables.written(index.with_radius(anchors.withColumn("windows", own).withColumn("seen", F.lit(float("-inf"))), FIRST), "state")
    best, rows, complete = None, FIRST, []
    while True:
        found = index.scan(state, positives)
        if best is not None:
            found = found.unionByName(best.join(state.select("anchor"), "anchor", "left_semi").select("anchor", "window", "vec_id", "row", "score"))
        best = tables.written(_best(found, ["anchor"], positives), "positives")
        edge = best.groupBy("anchor").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("least"))
        judged = state.join(edge, "anchor", "left")
        reach = F.when(F.col("held") == positives, distance(F.col("least")) + F.lit(index.slack))
        judged = tables.written(judged.withColumn("reach", reach).withColumn("done", (F.col("radius") == float("inf")) | (F.coalesce(F.col("reach"), F.lit(float("inf"))) <= F.col("radius"))), "judged")
        complete.append(best.join(judged.filter("done").select("anchor"), "anchor", "left_semi"))
        left = judged.filter("not done")
        if left.isEmpty():
            break
        rows *= GROWTH
        # With enough found, as far as certifies, and only products that are no lower than theirs.
        windows = F.when(F.col("reach").isNotNull(), F.array(window(F.lit(0), F.col("least"), most_of_all, 1))).otherwise(F.col("windows"))
        wider = index.with_radius(left.select(*anchors.columns, windows.alias("windows"), F.col("radius").alias("seen"), "reach"), rows)
        state = tables.written(wider.withColumn("radius", F.coalesce("reach", "radius")).select(*state.columns), "state")
    found_positives = complete[0]
    for more in complete[1:]:
        found_positives = found_positives.unionByName(more)
    # Windows of negatives: a positive's number is its place.
    least, most = F.expr(f"-({_floor(f'-score * {low}')})"), F.expr(_floor(f"score * {high}"))
    windowed = tables.written(found_positives.select("anchor", F.col("place").cast("bigint").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), least.cast("bigint").alias("low"), most.cast("bigint").alias("high")).filter("low <= high"), "windows")
    packed = windowed.groupBy("anchor").agg(F.array_sort(F.collect_list(window(F.col("window"), F.col("low"), F.col("high"), 0))).alias("windows"))
    state = tables.written(index.with_radius(anchors.join(packed, "anchor").withColumn("seen", F.lit(float("-inf"))), FIRST), "state")
    first = tables.written(_best(index.scan(state, negatives), ["anchor", "window"], negatives), "negatives")
    edge = first.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("least"))
    # A full window is certified at its last row's distance, any other at its outer end.
    narrowed = windowed.join(edge, ["anchor", "window"], "left").withColumn("low", F.when(F.col("held") == negatives, F.col("least")).otherwise(F.col("low")))
    narrowed = narrowed.groupBy("anchor").agg(F.array_sort(F.collect_list(window(F.col("window"), F.col("low"), F.col("high"), 0))).alias("windows"), F.min("low").alias("lowest"))
    rest = state.drop("windows").join(narrowed, "anchor").withColumn("reach", distance(F.col("lowest")) + F.lit(index.slack)).filter("reach > radius")
    rest = tables.written(rest.select(*anchors.columns, "windows", F.col("radius").alias("seen"), F.col("reach").alias("radius")), "state")
    found = first.select("anchor", "window", "vec_id", "row", "score").unionByName(index.scan(rest, negatives))
    last = tables.written(_best(found, ["anchor", "window"], negatives), "negatives")
    names = anchors.select("anchor", "anchor_id")
    # The caller runs these joins, under settings of its own.
    joined = last.join(windowed.select("anchor", "window", "positive_id", "positive_score").hint("merge"), ["anchor", "window"]).join(names.hint("merge"), "anchor")
    return joined.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor(product: str) -> str:
    """SQL for floor(product / 100) of whole numbers of any sign."""
    return f"(({product}) - pmod({product}, 100L)) div 100"
