"""Near-duplicate documents by b-bit MinHash.

One pass over the texts makes, for each document's set of word shingles, its size, a
fingerprint, 252 minima combined to 42 band keys of 6, and the two low bits of 256
minima packed into bit planes.  From there on:

1. Documents with equal sets are one class, found by fingerprint.
2. Candidates are classes that share a band.  A band never emits its pairs: in two
   rounds each member is paired with one hub, which is linear in its size, and what
   the confirmed pairs connect needs no further pair.  Bands that still hold several
   components then give their pairs across components, after an estimate from 4096
   more minima of one bit each that is made for the documents of these bands only.
3. Each candidate's similarity is estimated from the packed bits by bit counts,
   corrected for chance collisions, and pairs far under the threshold are dropped.
4. The rest is confirmed on full sets, made again from the texts of the two classes.
5. Components of the confirmed links.

At a similarity of 0.8 the chance that a pair shares no band is (1 - 0.8^6)^42 < 3e-6,
and the estimates' margins of 0.16 and 0.05 are over five standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext, tables
from .arrowtext import U64
from .components import components

MINIMA, ROWS, BANDS, BITS = 256, 6, 42, 2
MARGIN = 0.16
FINE_MINIMA, FINE_MARGIN = 4096, 0.05
_WORDS = MINIMA // 64


def _salts(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = arrowtext.mix(np.arange(1, n + 1, dtype=U64), seed)
    return (x >> U64(32)).astype(np.uint32), x.astype(np.uint32) | np.uint32(1)


_COARSE, _FINE = _salts(MINIMA, 7), _salts(FINE_MINIMA, 8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles, after lower-casing A-Z.

    With fewer words than ``size`` the whole sequence is the one shingle; without words
    the set is empty.
    """
    hashes, first, _, _ = arrowtext.byte_words(data, offsets, lower=True)
    windows, rows, _ = arrowtext.rolling(hashes, first, size)
    cuts = np.searchsorted(rows, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        if cuts[i] < cuts[i + 1]:
            yield np.unique(windows[cuts[i] : cuts[i + 1]])
        elif first[i] < first[i + 1]:
            yield arrowtext.run_hashes(hashes[first[i] : first[i + 1]], np.zeros(1, np.int64), first[i + 1 : i + 2] - first[i])
        else:
            yield np.zeros(0, U64)


def minima(shingles: np.ndarray, salts: tuple[np.ndarray, np.ndarray] = _COARSE) -> np.ndarray:
    """For each salt the minimum of a 32-bit hash over a set."""
    xor, odd = salts
    low = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    keys = (shingles >> U64(32)).astype(np.uint32)
    for k in range(0, len(xor), MINIMA):
        for at in range(0, len(keys), 2048):
            h = (keys[at : at + 2048][None, :] ^ xor[k : k + MINIMA, None]) * odd[k : k + MINIMA, None]
            np.minimum(low[k : k + MINIMA], (h ^ (h >> np.uint32(15))).min(axis=1), out=low[k : k + MINIMA])
    return low


def packed(low: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of minima as bit planes of 64-bit words."""
    mixed = arrowtext.mix(low.astype(U64), 11)
    return np.concatenate([np.packbits((mixed >> U64(b) & U64(1)).astype(np.uint8)).view(np.int64) for b in range(bits)])


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) of a set that is not empty."""
    low = minima(shingles)
    keys = low[: ROWS * BANDS].reshape(BANDS, ROWS).astype(U64)
    band = arrowtext.mix(np.arange(BANDS, dtype=U64), 3)
    for r in range(ROWS):
        band = arrowtext.mix(band ^ keys[:, r])
    return band.view(np.int64), packed(low, BITS)


_SKETCH = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, bits array<bigint>"


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                n, f1, f2, bands, bits = [], [], [], [], []
                for s in shingle_sets(data, offsets, size):
                    n.append(len(s))
                    f1.append(arrowtext.mix(s, 1).sum(dtype=U64))
                    f2.append(arrowtext.mix(s, 2).sum(dtype=U64))
                    if len(s):
                        b, p = sketch(s)
                        bands.append(b)
                        bits.append(p)
                cuts = np.append(0, np.cumsum(np.array(n) > 0))
                flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(f1, U64).view(np.int64)), pa.array(np.array(f2, U64).view(np.int64)), arrowtext.packed_list(flat(bands), cuts * BANDS, pa.int64()), arrowtext.packed_list(flat(bits), cuts * BITS * _WORDS, pa.int64())],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "bits"],
                )

    return run


def _fine(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                found = [packed(minima(s, _FINE), 1) for s in shingle_sets(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), arrowtext.packed_list(np.concatenate(found), np.arange(len(found) + 1) * (FINE_MINIMA // 64), pa.int64())], names=["id", "fine"])

    return run


def estimated(a: Column, b: Column, n: int = MINIMA, bits: int = BITS) -> Column:
    """Similarity from packed bits: the share of equal b-bit values, less the share that chance gives."""
    words = n // 64
    differ = [reduce(lambda x, y: x.bitwiseOR(y), [a[p * words + w].bitwiseXOR(b[p * words + w]) for p in range(bits)]) for w in range(words)]
    unequal = reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ])
    chance = 0.5**bits
    return (F.lit(1.0) - unequal / F.lit(float(n)) - F.lit(chance)) / F.lit(1 - chance)


def _confirm(size: int, hundredths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch, "text_b"):
                keep = []
                others = shingle_sets(data, offsets, size)
                for a, text, other in zip(part.column("a").to_pylist(), part.column("text_a"), others, strict=True):
                    if last is None or a != last:
                        raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                        last, hub = a, next(shingle_sets(raw, np.array([0, len(raw)]), size))
                    both = len(np.intersect1d(hub, other, assume_unique=True))
                    union = len(hub) + len(other) - both
                    keep.append(union > 0 and 100 * both >= hundredths * union)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def near_duplicates(documents: DataFrame, size: int = 5, hundredths: int = 80) -> DataFrame:
    """A row for each row of documents: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= hundredths * |A or B| for their sets of
    ``size``-word shingles.  component_id is the smallest doc_id reachable by links,
    itself included, and kept says whether that is the document's own.

    Texts that are null, empty or without words have an empty set and are linked with
    nothing.  Rows that repeat a doc_id count as one document, whether their texts agree
    or not: they share a component, and each of their texts is compared.
    A null doc_id is linked with nothing; its component is null and it is kept.  Long
    texts are read whole, other columns are ignored, an empty table gives no rows.
    """
    spark = documents.sparkSession
    with tables.temporary(spark):  # only the result stays
        return tables.stay(_near_duplicates(documents, size, hundredths), "near-duplicates")


def _near_duplicates(documents: DataFrame, size: int, hundredths: int) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketches = tables.written(docs.mapInArrow(_sketches(size), _SKETCH), "sketches")
    nodes = sketches.filter("doc_id is not null and n_shingles > 0")
    fingerprint = F.struct("f1", "f2", "n_shingles")
    if not nodes.groupBy("doc_id").agg(F.min(fingerprint).alias("low"), F.max(fingerprint).alias("high")).filter("low <> high").isEmpty():
        return _by_rows(docs, size, hundredths)

    # 1. Classes of equal sets; the smallest id stands for the class.
    classes = nodes.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    members = tables.written(nodes.select("doc_id", "f1", "f2", "n_shingles").join(classes, ["f1", "f2", "n_shingles"]).select("doc_id", "rep"), "members")
    repeats = members.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = nodes.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2", "n_shingles"), ["doc_id", "f1", "f2", "n_shingles"]).dropDuplicates(["doc_id", "f1", "f2"])
    reps = tables.written(reps.select(F.col("doc_id").alias("id"), "n_shingles", "bands", "bits"), "classes")

    # 2. Bands with more than one class.
    rows = tables.written(reps.select("id", F.explode("bands").alias("band")), "bands")
    shared = rows.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub <> top")
    rows = tables.written(rows.join(shared.select("band", "hub"), "band"), "shared-bands")
    involved = tables.written(rows.select(F.col("id").alias("doc_id")).distinct(), "involved")
    texts = tables.written(docs.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    def similar(pairs: DataFrame) -> DataFrame:
        """3. Pairs (a, b) whose sizes allow the threshold and whose estimate comes near it."""
        a = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("bits_a"))
        b = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bits_b"))
        known = pairs.join(a, "a").join(b, "b").filter(_near("na", "nb", "bits_a", "bits_b", hundredths))
        return known.select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """4. Those of the pairs that are links on full sets."""
        with_texts = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        checked = with_texts.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, hundredths), "a bigint, b bigint, linked boolean")
        return tables.written(checked.filter("linked").select("a", "b"), "confirmed")

    links = repeats
    tested = None
    for turn in range(3):
        if turn == 0:
            pairs = rows.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        else:
            found = tables.written(components(links), "components")
            label = found.withColumnRenamed("component", "c")
            now = rows.select("id", "band").join(label, "id", "left").withColumn("c", F.coalesce("c", "id"))
            now = tables.written(now, "labelled-bands")
            # Only bands that hold several components go on.
            order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("hub"), F.col("c").alias("hub_c"))
            mixed = now.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(order).alias("h")).filter("low <> high")
            now = now.join(mixed.select("band", "h.hub", "h.hub_c"), "band")
            if turn == 1:
                pairs = now.filter("c <> hub_c").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
            else:
                now = tables.written(now, "mixed-bands")
                finer = texts.join(now.select(F.col("id").alias("doc_id")).distinct(), "doc_id").mapInArrow(_fine(size), "id bigint, fine array<bigint>")
                now = tables.written(now.join(reps.select("id", "n_shingles", "bits", "bands"), "id").join(finer, "id"), "mixed-bands")
                x, y = now.alias("x"), now.alias("y")
                first_shared = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.col("x.bands")[i] == F.col("y.bands")[i])[0]
                finely = estimated(F.col("x.fine"), F.col("y.fine"), FINE_MINIMA, 1) >= F.lit(hundredths / 100 - FINE_MARGIN)
                across = (F.col("x.c") != F.col("y.c")) & (F.col("x.id") < F.col("y.id")) & _near("x.n_shingles", "y.n_shingles", "x.bits", "y.bits", hundredths) & finely & (F.col("x.bands")[first_shared] == F.col("x.band"))
                pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & across).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        # The last round's pairs were estimated where they were found.
        pairs = tables.written(pairs if turn == 2 else similar(pairs), "candidates")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = links.unionByName(confirmed(pairs))
    found = components(links)
    labels = sketches.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return labels.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _by_rows(docs: DataFrame, size: int, hundredths: int) -> DataFrame:
    """The same where a doc_id stands for unequal texts: rows are compared under keys of their own, and what they link holds for their ids."""
    rows = tables.written(docs.withColumn("key", F.monotonically_increasing_id()), "keyed-documents")
    found = _near_duplicates(rows.filter("doc_id is not null").select(F.col("key").alias("doc_id"), "text"), size, hundredths)
    found = tables.written(found.select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("group")).join(rows.select("key", "doc_id"), "key"), "linked-rows")
    lowest = found.groupBy("group").agg(F.min("doc_id").alias("a"))
    component = components(found.join(lowest, "group").select("a", F.col("doc_id").alias("b")))
    known = found.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    known = known.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    without = rows.filter("doc_id is null").select("doc_id", "text").mapInArrow(_sketches(size), _SKETCH)
    return known.unionByName(without.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def _near(na: str, nb: str, bits_a: str, bits_b: str, hundredths: int) -> Column:
    sizes = 100 * F.least(na, nb) >= hundredths * F.greatest(na, nb)
    return sizes & (estimated(F.col(bits_a), F.col(bits_b)) >= F.lit(hundredths / 100 - MARGIN))
