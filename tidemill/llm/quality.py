"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Words are runs of letters, of digits and of other marks, so that marks stuck to
words are words of their own.  Two streams are read: the lower-cased words (1- and
2-grams) and the words' forms (2- and 3-grams), where a form is the case of a word,
whether it repeats the word before it, or the mark itself.  All n-grams are hashed
into one space, and a text is the vector of their frequencies, damped by a logarithm
and of unit length.  Weights are trained by follow-the-regularised-leader updates with a learning
rate for each coordinate; a score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext, sampling
from .arrowtext import U64

BITS = 18
#: Labelled documents that a model is fitted on, about.
ROWS = 5000

_KIND = np.full(256, 3, np.uint8)  # a mark
_KIND[list(b" \t\n\v\f\r")] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[list(range(48, 58))] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LATIN_UPPER = np.arange(0x80, 0x9F)  # second byte of À-Þ after 0xC3


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, form hashes, first token of each row)."""
    kind = _KIND[data]
    n = len(data)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    bounds = np.flatnonzero(new)
    ends = np.append(bounds[1:], n)
    real = kind[bounds] > 0
    starts, ends = bounds[real], ends[real]
    first = np.searchsorted(starts, offsets)
    word = arrowtext.run_hashes(arrowtext.LOWER[data], starts, ends)
    upper = _UPPER[data]
    if n > 1:
        upper[1:] |= (data[:-1] == 0xC3) & np.isin(data[1:], _LATIN_UPPER)
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(upper, out=sums[1:])
    letters = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    size, ups = letters[ends] - letters[starts], sums[ends] - sums[starts]
    head = upper[starts] | np.where(starts + 1 < n, upper[np.minimum(starts + 1, n - 1)], 0)
    case = np.where((ups == size) & (size > 1), 1, np.where(head > 0, 2, 3))
    kinds = kind[starts]
    # Does a word repeat the word before it, whatever marks stand between?
    is_word = np.flatnonzero(kinds == 1)
    same = np.zeros(len(starts), bool)
    if len(is_word) > 1:
        row = np.searchsorted(first, is_word, "right")
        same[is_word[1:]] = (word[is_word[1:]] == word[is_word[:-1]]) & (row[1:] == row[:-1])
    form = np.where(kinds == 1, (case + 4 * same).astype(U64), np.where(kinds == 2, U64(9), word))
    return word, form, first


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinates, values, first entry of each row): each row has unit length or is empty."""
    word, form, first = tokens(data, offsets)
    found, owner = [], []
    for stream, size, seed in ((word, 1, 0), (word, 2, 1), (form, 2, 2), (form, 3, 3)):
        h, rows, _ = arrowtext.rolling(stream, first, size)
        found.append(arrowtext.mix(h, seed) >> U64(64 - BITS))
        owner.append(rows)
    keys, counts = np.unique(np.concatenate(owner).astype(U64) << U64(BITS) | np.concatenate(found), return_counts=True)
    rows = (keys >> U64(BITS)).astype(np.int64)
    values = np.log1p(counts)
    length = np.sqrt(np.bincount(rows, weights=values * values, minlength=len(offsets) - 1))
    return (keys & U64((1 << BITS) - 1)).astype(np.int32), (values / length[rows]).astype(np.float32), np.searchsorted(rows, np.arange(len(offsets)))


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) from (label, coordinates, values)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            label, at, x = samples[i]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in arrowtext.chunks(batch):
            at, values, cuts = vectors(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), arrowtext.packed_list(at, cuts, pa.int32()), arrowtext.packed_list(values, cuts, pa.float32())], names=["doc_id", "label", "at", "x"])


def fit(documents: DataFrame, labels: DataFrame, rows: int = ROWS, seed: int = 1) -> np.ndarray | None:
    """Weights learned from ``labels.quality`` outside the held-out fold; None without labelled texts.

    Only 0 and 1 count as labels; a null text is read as an empty one.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    chosen = sampling.bounded(marked, "label", rows, seed, per_label=False).distinct()
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # At most about ``rows`` ids are broadcast.
    got = sampling.fitting(docs.join(F.broadcast(chosen), "doc_id"), seed).mapInArrow(_featurise, "doc_id bigint, label int, at array<int>, x array<float>").toArrow()
    if not got.num_rows:
        return None
    ids, marks, at, x = (got.column(c).combine_chunks() for c in ("doc_id", "label", "at", "x"))
    order = np.lexsort([marks.to_numpy(), ids.to_numpy()])
    return train([(marks[int(i)].as_py(), at[int(i)].values.to_numpy(), x[int(i)].values.to_numpy()) for i in order], seed=seed)


def score(documents: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """documents' doc_id with score, the probability of label 1.

    Null and empty texts get the score of the bias alone; without weights every score
    is 0.5.  Long texts are read whole.  Repeated rows give repeated results, other
    columns are ignored, an empty table gives no rows.
    """
    if weights is None:
        weights = np.zeros((1 << BITS) + 1, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                at, values, cuts = vectors(data, offsets)
                rows = np.repeat(np.arange(part.num_rows), np.diff(cuts))
                dots = np.bincount(rows, weights=weights[at] * values, minlength=part.num_rows) + float(weights[-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(dots, -30, 30))))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
