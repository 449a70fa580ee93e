"""Words of Arrow string columns as numpy arrays.

Texts are never turned into Python strings here: words are ranges of the
column's bytes (or of its code points), and their hashes come from prefix sums of
a polynomial modulo 2^64, so every step is a vectorised pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on together; one longer text is taken whole.
CHUNK_BYTES = 500_000
#: Values that are hashed together, about; only a longer run needs larger tables.
SPAN = 1 << 19

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (splitmix64)."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text: (slice, bytes, offsets)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        part = batch.slice(start, end - start)
        yield part, *string_bytes(part.column(text))
        start = end


def byte_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words [^\x20\x09-\x0D]+ of UTF-8 bytes.
NOT_SPACE = byte_table(b" \t\n\v\f\r")
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first run of each row) of the runs of True, none across rows."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of values, by ascending start; equal ranges have equal hashes wherever they stand."""
    if len(values) <= SPAN:
        return _hash_span(values, starts, ends)
    found = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SPAN)))
        a, b = int(starts[i]), int(ends[i:j].max())
        found[i:j] = _hash_span(values[a:b], starts[i:j] - a, ends[i:j] - a)
        i = j
    return found


def _hash_span(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(values)
    sums = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts])


def rolling(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every ``size`` consecutive words of one row: (hash, row, position in row)."""
    counts = np.diff(first)
    windows = np.maximum(counts - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = first[:-1][rows] + at
    return run_hashes(hashes, starts, starts + size), rows, at


def byte_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, table: np.ndarray = NOT_SPACE):
    """Words of byte texts: (hashes, first word of each row, starts, ends)."""
    if lower:
        data = LOWER[data]
    starts, ends, first = runs(table[data], offsets)
    return run_hashes(data, starts, ends), first, starts, ends


_folded: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For each code point, its lower-case letter, or 0 where it is no letter."""
    if not _folded:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with row offsets as code points with row offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[offsets]


def packed_list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
