"""Exact repeats of long passages, by fixed-block anchors.

Every document is cut into reference blocks of half a window, without overlap, and
the blocks are indexed by hash; so every window of W words holds at least one whole
block of its document.  Every rolling block of every document probes the index.  A
probe that finds a block of a smaller doc_id marks its place, and a block that is
found by a larger doc_id marks its own; only windows around marked places can repeat.
Their full hashes are compared next, consecutive windows that repeat extend to
maximal repeats, and the words under them are removed.

Places travel in packed rows, many per row, grouped by hash on the way out and by
document on the way back.  Nothing pairs the members of a group: what a group needs
to know is its smallest and its largest doc_id.  So places are aggregated before they
are sent: what is a hit already among the places of one task asks for no answer.  Equal
texts that meet in one batch send only the one with the smallest doc_id.

Blocks are compared by 32 bits and the group's number, where a chance hit only costs
a comparison; windows by two independent hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import arrowtext, packing, tables
from .arrowtext import U64

_HOME_SALT = 29
#: Places that a task of the first step holds before it sends them on.
FLUSH = 1 << 19
#: Groups of blocks and of texts for each partition: with several, partitions are of even size and a group is a small part of one.
BLOCK_GROUPS, HOMES = 4, 2
_PACKED = pa.schema([("grp", pa.int32()), *packing.ARROW])
_PACKED_DDL = f"grp int, {packing.SCHEMA}"


def homes(doc: np.ndarray, n: int) -> np.ndarray:
    """The group in which a document's text waits for what is found about it."""
    return (arrowtext.mix(doc.astype(np.int64).view(U64), _HOME_SALT) % U64(n)).astype(np.int64)


def _marks(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    return arrowtext.run_hashes(hashes, first[:-1], first[1:])


def _rows(groups: np.ndarray, n: int, doc: np.ndarray, mark: np.ndarray, at: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
    cells = [(g, *packing.pack_entries(doc[i], mark[i], at[i], None if key is None else key[i])) for g, i in packing.split(groups, n)]
    columns = list(zip(*cells, strict=True)) or [[]] * len(_PACKED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)


def _probe(window: int, groups: int, n_homes: int):
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                hashes, first, _, _ = arrowtext.byte_words(data, offsets)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                long = np.diff(first) >= window
                # Of equal texts, all but the smallest doc_id are settled: whatever they repeat, that one repeats or holds.
                marks = _marks(hashes, first)
                order = np.lexsort([ids, marks])
                order = order[long[order]]
                again = np.zeros(part.num_rows, bool)
                if len(order) > 1:
                    again[order[1:]] = marks[order[1:]] == marks[order[:-1]]
                h, rows, at = arrowtext.rolling(hashes, first, block)
                use = long[rows] & ~again[rows]
                held.append((h[use], ids[rows[use]], at[use].astype(np.int32)))
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield _sent(held, block, groups, n_homes)
                    held, n = [], 0
                if again.any():
                    lowest = {marks[i]: ids[i] for i in order[~again[order]]}
                    copies = np.array([i for i in np.flatnonzero(again) if ids[i] > lowest[marks[i]]], np.int64)
                    if len(copies):
                        yield _rows(groups + homes(ids[copies], n_homes), groups + n_homes, ids[copies], marks[copies], np.full(len(copies), -1), np.zeros(len(copies), np.uint32))
        if n:
            yield _sent(held, block, groups, n_homes)

    return run


def _hits(doc: np.ndarray, reference: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is it a hit, smallest doc_id with the reference block, largest doc_id) of places that stand together by block."""
    size = np.diff(np.append(heads, len(doc)))
    lowest = np.repeat(np.minimum.reduceat(np.where(reference, doc, np.iinfo(np.int64).max), heads), size)
    highest = np.repeat(np.maximum.reduceat(doc, heads), size)
    return (lowest < doc) | (reference & (highest > doc)), lowest, highest


def _sent(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], block: int, groups: int, n_homes: int) -> pa.RecordBatch:
    """Places by the group of their block's hash, but those that are known as hits already by the group of their text.

    Of the places of one block, those that are hits among the ones held here need no
    answer.  Two of them go out all the same, as they decide for others: the smallest
    doc_id with the reference block and the largest.  So a passage that stands in very
    many documents sends few places for each batch.
    """
    h, doc, at = (np.concatenate([x[j] for x in held]) for j in range(3))
    order, heads = packing.by_key(h)
    d, reference = doc[order], at[order] % block == 0
    hit, lowest, highest = _hits(d, reference, heads)
    known = np.zeros(len(h), bool)
    known[order] = hit & ~(reference & (d == lowest)) & (d != highest)
    group = ((h >> U64(32)) % U64(groups)).astype(np.int64)
    group[known] = groups + homes(doc[known], n_homes)
    return _rows(group, groups + n_homes, doc, np.zeros(len(h), U64), at, h.astype(np.uint32))


def _match_blocks(window: int, groups: int, n_homes: int):
    block = window // 2

    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        if group >= groups:  # known already: on to the text
            return table.set_column(0, _PACKED.field(0), pa.array(np.full(table.num_rows, group - groups, np.int32))).cast(_PACKED)
        doc, _, at, key = packing.unpack_entries(table, np.uint32)
        order, heads = packing.by_key(key)
        hit, _, _ = _hits(doc[order], at[order] % block == 0, heads)
        hit = np.sort(order[hit])
        return pa.Table.from_batches([_rows(homes(doc[hit], n_homes), n_homes, doc[hit], np.zeros(len(hit), U64), at[hit], None)], schema=_PACKED)

    return run


def _match_windows(n_homes: int):
    def run(table: pa.Table) -> pa.Table:
        doc, mark, at, key = packing.unpack_entries(table, U64)
        order, heads = packing.by_keys(*key.reshape(-1, 2).T)
        d = doc[order]
        lowest = np.minimum.reduceat(d, heads) if len(d) else d
        hit = np.sort(order[np.repeat(lowest, np.diff(np.append(heads, len(d)))) < d])
        return pa.Table.from_batches([_rows(homes(doc[hit], n_homes), n_homes, doc[hit], mark[hit], at[hit], None)], schema=_PACKED)

    return run


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def _by_doc(doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    if not len(doc):
        return {}
    order = np.lexsort([at, mark, doc])
    doc, mark, at = doc[order], mark[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]))
    return {(int(doc[i]), int(mark[i])): at[i:j] for i, j in zip(new, np.append(new[1:], len(doc)), strict=True)}


def _candidates(window: int, groups: int, with_text: bool, out_schema: pa.Schema):
    """Texts meet the marked places of their documents: settled results, or the text and the windows to compare."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _by_doc(*packing.unpack_entries(right, None)[:3])
        out = []
        w_doc, w_mark, w_at, w_key = [], [], [], []
        blank = lambda m: {f: pa.nulls(m, t) for f, t in zip(out_schema.names, out_schema.types, strict=True)}
        for batch in left.combine_chunks().to_batches():
            for part, data, offsets in arrowtext.chunks(batch):
                raw = data.tobytes()
                hashes, first, _, _ = arrowtext.byte_words(data, offsets)
                marks, ids, n = _marks(hashes, first), part.column("doc_id").to_pylist(), np.diff(first)
                sha, removed, text = [], [], []
                for i, doc in enumerate(ids):
                    at = found.get((doc, 0)) if n[i] >= window else None
                    if (doc, int(marks[i])) in found:  # a copy of a text with a smaller doc_id
                        sha.append(sha256(b"").hexdigest())
                        removed.append(int(n[i]))
                        text.append("" if with_text else None)
                    elif at is None:
                        sha.append(sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest())
                        removed.append(0)
                        text.append(part.column("text")[i].as_py() if with_text else None)
                    else:
                        windows = int(n[i]) - window + 1
                        lo = np.maximum(at - (window - window // 2), 0)
                        starts = np.flatnonzero(_between(lo[lo < windows], np.minimum(at[lo < windows], windows - 1), windows))
                        own = hashes[first[i] : first[i + 1]]
                        w_key.append(np.stack([arrowtext.run_hashes(x, starts, starts + window) for x in (own, arrowtext.mix(own, 9))], axis=1))
                        w_doc.append(np.full(len(starts), doc, np.int64))
                        w_mark.append(np.full(len(starts), marks[i], U64))
                        w_at.append(starts)
                        sha.append(None)
                        removed.append(None)
                        text.append(part.column("text")[i].as_py())
                rows = blank(part.num_rows) | {"doc_id": part.column("doc_id"), "text": pa.array(text, pa.string()), "extra": part.column("extra").cast(out_schema.field("extra").type), "home": part.column("home"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "is_doc": pa.array([True] * part.num_rows)}
                out.append(pa.RecordBatch.from_arrays([rows[f] for f in out_schema.names], schema=out_schema))
        if w_key:
            key = np.concatenate(w_key)
            packed = _rows((arrowtext.mix(key[:, 0], 5) % U64(groups)).astype(np.int64), groups, np.concatenate(w_doc), np.concatenate(w_mark), np.concatenate(w_at), key)
            rows = blank(packed.num_rows) | {c: packed.column(c) for c in _PACKED.names} | {"is_doc": pa.array([False] * packed.num_rows)}
            out.append(pa.RecordBatch.from_arrays([rows[f] for f in out_schema.names], schema=out_schema))
        return pa.Table.from_batches(out, schema=out_schema)

    return run


def _between(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi + 1, -1)
    return np.cumsum(step[:-1]) > 0


def _settle(window: int, with_text: bool, out_schema: pa.Schema):
    """Texts meet the places of their repeating windows: what stays of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _by_doc(*packing.unpack_entries(right, None)[:3])
        out = []
        for batch in left.combine_chunks().to_batches():
            for part, data, offsets in arrowtext.chunks(batch):
                raw = data.tobytes()
                hashes, first, starts, ends = arrowtext.byte_words(data, offsets)
                marks = _marks(hashes, first)
                sha, removed, text = [], [], []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    a, b, n = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], int(first[i + 1] - first[i])
                    at = found.get((doc, int(marks[i])))
                    gone = covered(at, n, window) if at is not None else np.zeros(n, bool)
                    kept = ~gone
                    # Runs of kept words, each a range of the text from its first word to the next removed word.
                    begin, end, _ = arrowtext.runs(kept, np.array([0, n]))
                    pieces = [raw[a[x] : b[y - 1]] for x, y in zip(begin, end, strict=True)]
                    sha.append(sha256(b" ".join(w for p in pieces for w in p.split())).hexdigest())
                    removed.append(int(gone.sum()))
                    whole = raw[offsets[i] : offsets[i + 1]]
                    text.append((whole if not gone.any() else b"\n".join(pieces)).decode("utf-8", "replace") if with_text else None)
                rows = {c: part.column(c).cast(out_schema.field(c).type) for c in ("doc_id", "extra", "n_words")} | {"text": pa.array(text, pa.string()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
                out.append(pa.RecordBatch.from_arrays([rows[f] for f in out_schema.names], schema=out_schema))
        return pa.Table.from_batches(out, schema=out_schema)

    return run


def remove_repeats(documents: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """Words of each document that are not under a repeated window.

    Words are [^\\x20\\x09-\\x0D]+.  A word is removed if a window of ``window`` words
    covers it whose word sequence also starts in a document with a smaller doc_id;
    windows are judged on the input.  A row for each row of documents: doc_id, text
    (what is left, kept ranges unchanged and joined by a line feed; null unless
    ``with_text``), extra (a struct of the other columns), n_words, n_removed,
    kept_sha256 (of the kept words joined by one space).

    Texts that are null or shorter than a window lose nothing; a null text stays null.
    Rows that share a doc_id do not make each other repeat, whether their texts agree
    or not.  A row with a null doc_id neither loses words nor makes others lose any.
    Long texts are read whole; an empty table gives no rows.
    """
    spark = documents.sparkSession
    parts = tables.partitions(spark)
    groups, n_homes = BLOCK_GROUPS * parts, HOMES * parts
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    extra = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), extra.alias("extra"))
    slim = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")

    base = _nullable(docs.schema)
    result = T.StructType.fromDDL("n_words bigint, n_removed bigint, kept_sha256 string")
    home, packed = T.StructType.fromDDL("home int"), T.StructType.fromDDL(f"is_doc boolean, {_PACKED_DDL}")
    with tables.temporary(spark):
        probes = slim.mapInArrow(_probe(window, groups, n_homes), _PACKED_DDL)
        found = tables.written(probes.groupBy("grp").applyInArrow(_match_blocks(window, groups, n_homes), _PACKED_DDL), "block-hits")
        placed = docs.filter("doc_id is not null").mapInArrow(_with_home(n_homes, to_arrow_schema(base)), _joined(base, home))
        both = _joined(base, home, result, packed)
        both = placed.groupBy("home").cogroup(found.withColumnRenamed("grp", "home").groupBy("home")).applyInArrow(_candidates(window, parts, with_text, to_arrow_schema(both)), both)
        both = tables.stay(both, "window-candidates")

    windows = both.filter("not is_doc").select("grp", *[c for c, _ in packing.ARROW])
    repeated = tables.written(windows.groupBy("grp").applyInArrow(_match_windows(n_homes), _PACKED_DDL), "window-hits")
    waiting = both.filter("is_doc and n_removed is null").select("doc_id", "text", "extra", "home", "n_words")
    out = _joined(base, result)
    settled = waiting.groupBy("home").cogroup(repeated.withColumnRenamed("grp", "home").groupBy("home")).applyInArrow(_settle(window, with_text, to_arrow_schema(out)), out)
    done = both.filter("is_doc and n_removed is not null").select("doc_id", "text", "extra", "n_words", "n_removed", "kept_sha256")
    # Rows without an id need no match, and together they would be one hot group.
    free = docs.filter("doc_id is null").mapInArrow(_untouched(with_text, to_arrow_schema(out)), out)
    return done.unionByName(settled).unionByName(free)


def _untouched(with_text: bool, out_schema: pa.Schema):
    """Rows that lose nothing, with their counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                raw, n = data.tobytes(), part.num_rows
                words = [raw[offsets[i] : offsets[i + 1]].split() for i in range(n)]
                found = {
                    "doc_id": part.column("doc_id"), "text": part.column("text") if with_text else pa.nulls(n, pa.string()), "extra": part.column("extra"),
                    "n_words": pa.array([len(w) for w in words], pa.int64()), "n_removed": pa.array([0] * n, pa.int64()), "kept_sha256": pa.array([sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) for f in out_schema], schema=out_schema)

    return run


def _joined(*parts: T.StructType) -> T.StructType:
    return T.StructType([f for part in parts for f in part.fields])


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with every field nullable, as results of Python functions are declared."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType))
    return kind


def _with_home(groups: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            home = pa.array(homes(ids, groups).astype(np.int32))
            columns = [c.cast(t) for c, t in zip(batch.columns, schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, home], names=[*schema.names, "home"])

    return run
