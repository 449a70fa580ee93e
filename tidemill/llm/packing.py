"""Numpy arrays as compressed binary cells, so that one row carries many small values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from .arrowtext import U64


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Compressed bytes of an array; ``delta`` for ascending or nearly constant values."""
    if delta and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(cell: bytes, kind: type, delta: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), kind)
    return np.cumsum(values, dtype=kind) if delta else values


SCHEMA = "docs binary, marks binary, counts binary, at binary, keys binary"
ARROW = [(c, pa.binary()) for c in ("docs", "marks", "counts", "at", "keys")]


def pack_entries(doc: np.ndarray, mark: np.ndarray, at: np.ndarray, key: np.ndarray | None) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """Entries (document, mark of its text, position, key) that stand together by document, as one row's cells."""
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])) if len(doc) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(doc))).astype(np.int32)
    return pack(doc[new], True), pack(mark[new]) if mark.any() else b"", pack(counts), pack(at.astype(np.int32), True), key.tobytes() if key is not None else b""


def unpack_entries(table: pa.Table, kind: type | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """All entries of a table's rows: (document, mark, position, key)."""
    doc, mark, at, key = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int32)], [np.zeros(0, kind or np.uint8)]
    for docs, marks, counts, places, keys in zip(*(table.column(c).to_pylist() for c, _ in ARROW), strict=True):
        n = unpack(counts, np.int32)
        doc.append(np.repeat(unpack(docs, np.int64, True), n))
        mark.append(np.repeat(unpack(marks, U64), n) if marks else np.zeros(int(n.sum()), U64))
        at.append(unpack(places, np.int32, True))
        if kind:
            key.append(np.frombuffer(keys, kind))
    return np.concatenate(doc), np.concatenate(mark), np.concatenate(at), np.concatenate(key) if kind else None


def split(groups: np.ndarray, n: int) -> list[np.ndarray]:
    """For each group that occurs, (group, indices in order)."""
    order = np.argsort(groups.astype(np.uint16) if n <= 65536 else groups, kind="stable")
    cuts = np.searchsorted(groups[order], np.arange(n + 1))
    return [(g, order[cuts[g] : cuts[g + 1]]) for g in np.flatnonzero(np.diff(cuts))]


def by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by key, first place of each distinct key in it)."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def by_keys(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of keys."""
    order, heads = by_key(first)
    again = np.ones(len(first), bool)
    again[heads] = False
    ordered = second[order]
    if (again[1:] & (ordered[1:] != ordered[:-1])).any():  # one first key with several second ones
        order = np.lexsort([second, first])
        a, b = first[order], second[order]
        heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order, heads
