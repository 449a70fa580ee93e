"""Language identification by averaged subword embeddings and a linear softmax.

A text's letters are lower-cased and cut into words; all 2- to 4-grams of letters
with word boundaries are hashed into buckets, each bucket has an embedding, and a
softmax layer reads their average.  Both are trained by stochastic gradient descent
in numpy on a bounded sample.

Scores are calibrated by a temperature fitted on a part of the sample that was not
trained on.  A softmax is sure of itself on noise and foreign languages too, so
rejection has a measure of its own: the mean logarithm of the frequency that a text's
grams have in the training texts.  What is usual depends on a text's length, so for
each of several lengths texts are redrawn from the calibration part, and the threshold
is the value that a stated share of its right predictions falls below.

Since the layer is linear, a trained model is a table of class scores by bucket, with
one more column for the frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext, sampling

BUCKET_BITS = 15
GRAMS = (2, 3, 4)
DIMENSIONS = 16
#: Labelled documents of each language that a model is fitted on, about.
ROWS_PER_LANGUAGE = 800
UNDETERMINED = "und"
#: Grams of the texts that rejection is calibrated for; a gram overlaps its neighbours, so OVERLAP of them tell as much as one drawn alone.
LENGTHS, OVERLAP = (6, 12, 24, 48, 96, 192, 384, 768, 1536, 3072), 3
#: Share of right predictions that may be rejected.
LOSE = 0.002
_STEP = np.uint32(0x01000193)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, row of each, letters of each row) of UTF-8 texts."""
    points, heads = arrowtext.code_points(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(heads))
    letters = np.zeros(len(points) + len(offsets) + max(GRAMS), np.uint32)
    folded = arrowtext.fold_table()[points]
    letters[np.arange(len(points)) + rows + 1] = folded  # a zero stands between texts
    n_letters = np.bincount(rows[folded > 0], minlength=len(offsets) - 1)
    row_of = np.zeros(len(letters), np.int32)
    row_of[np.arange(len(points)) + rows + 1] = rows
    row_of[heads[:-1] + np.arange(len(offsets) - 1)] = np.arange(len(offsets) - 1)
    inner = letters > 0
    h, mask = letters, None
    found, owner = [], []
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _STEP + letters[n - 1 :]
        if n == 2:
            mask = inner[:-1] | inner[1:]
            closed = np.ones(len(h), bool)
        else:
            closed = closed[:-1] & inner[n - 2 : n - 2 + len(h)]
            mask = closed
        at = np.flatnonzero(mask)
        found.append(((h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - BUCKET_BITS))
        owner.append(row_of[at])
    return np.concatenate(found), np.concatenate(owner), n_letters


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # class scores by bucket
    bias: np.ndarray
    temperature: float
    usual: np.ndarray  # logarithm of the frequency, by bucket
    thresholds: np.ndarray  # least mean of it, for each of LENGTHS

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class scores of each text, its letters, whether it is too unusual for any language known)."""
        buckets, rows, letters = grams(data, offsets)
        n = len(offsets) - 1
        counts = np.bincount(rows, minlength=n)
        some = np.maximum(counts, 1)
        sums = np.stack([np.bincount(rows, weights=self.table[buckets, c], minlength=n) for c in range(len(self.languages))], axis=1)
        usual = np.bincount(rows, weights=self.usual[buckets], minlength=n) / some
        return sums / some[:, None] + self.bias, letters, usual < self.least(counts)

    def least(self, counts: np.ndarray) -> np.ndarray:
        """The threshold for texts of so many grams."""
        return np.interp(np.log(np.maximum(counts, 1)), np.log(LENGTHS), self.thresholds)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least loss, by golden sections of its logarithm.

    Targets are (n + 1) / (n + 2), as if one more text of another class had been seen, so
    that classes which the sample separates perfectly do not ask for a temperature of 0.
    """
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    target[np.arange(n), truth] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z -= z.max(axis=1, keepdims=True)
        return float(-(target * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum())

    a, b, ratio = -12.0, 12.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 0.5, seed: int = 1, lose: float = LOSE) -> Model:
    """Fit a model to (language, buckets, counts); ``lose``: share of right predictions that may be rejected."""
    languages = sorted({s[0] for s in samples})
    rng = np.random.default_rng(seed)
    k = len(languages)
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32)
    samples = [s for s in samples if len(s[1])]
    calibration, fit = samples[::5], [s for i, s in enumerate(samples) if i % 5] or samples
    place = {x: i for i, x in enumerate(languages)}
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            language, buckets, counts = fit[i]
            weight = (counts / counts.sum()).astype(np.float32)
            vectors = embed[buckets]
            x = weight @ vectors
            z = x @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[place[language]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = layer @ p
            layer -= step * np.outer(x, p)
            bias -= step * 0.1 * p
            # An average passes its gradient on by share; scaled so that frequent grams move at the usual speed.
            embed[buckets] = vectors - (step * len(buckets) * 0.2) * weight[:, None] * back
            done += 1
    model = Model(languages, (embed @ layer).astype(np.float32), bias.astype(np.float64), 1.0, _usual(fit, languages), np.full(len(LENGTHS), -np.inf))
    if calibration:
        logits = np.array([(c / c.sum()) @ model.table[b] + model.bias for _, b, c in calibration])
        truth = np.array([place[s[0]] for s in calibration])
        if k > 1:
            model.temperature = fit_temperature(logits, truth)
        right = [s for s, good in zip(calibration, logits.argmax(axis=1) == truth, strict=True) if good]
        model.thresholds = _thresholds(right, model.usual, lose, rng)
    return model


def _usual(samples: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str]) -> np.ndarray:
    """Logarithm of each bucket's frequency, languages counting alike and a bucket never seen as half a time."""
    total = np.zeros(1 << BUCKET_BITS)
    for language in languages:
        counts = np.zeros(1 << BUCKET_BITS)
        for own, buckets, n in samples:
            if own == language:
                np.add.at(counts, buckets, n)
        total += (counts + 0.5) / (counts + 0.5).sum()
    return np.log(total / max(1, len(languages))).astype(np.float32)


def _thresholds(samples: list[tuple[str, np.ndarray, np.ndarray]], usual: np.ndarray, lose: float, rng: np.random.Generator, draws: int = 4000) -> np.ndarray:
    """For each length the mean that a share ``lose`` of texts of it falls below, drawn from the samples that are as long.

    Samples that are shorter tell nothing about a length; where there is none, the next
    shorter length holds.
    """
    found = np.full(len(LENGTHS), -np.inf)
    for i, length in enumerate(LENGTHS):
        long = [s for s in samples if s[2].sum() >= length]
        means = []
        for n in range(draws if long else 0):
            _, buckets, counts = long[n % len(long)]
            drawn = rng.choice(usual[buckets], max(1, length // OVERLAP), p=counts / counts.sum())
            means.append(drawn.mean())
        if means:
            found[i] = np.quantile(means, lose, method="lower")
        elif i:
            found[i] = found[i - 1]
    return found


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in arrowtext.chunks(batch):
            buckets, rows, _ = grams(data, offsets)
            keys, counts = np.unique(rows.astype(np.int64) << BUCKET_BITS | buckets, return_counts=True)
            cuts = np.searchsorted(keys >> BUCKET_BITS, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("doc_id"), arrowtext.packed_list((keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32), cuts, pa.int32()), arrowtext.packed_list(counts.astype(np.int32), cuts, pa.int32())],
                names=["lang", "doc_id", "buckets", "counts"],
            )


def fit(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, seed: int = 1) -> Model | None:
    """A model from text and non-null lang of documents outside the held-out fold; None if there are none."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sample = sampling.bounded(docs.filter(F.col("text").isNotNull()).select("doc_id", "lang", "text"), "lang", rows_per_language, seed, per_label=True)
    # The sample's ids are bounded by rows_per_language for each language, which the counts have shown.
    chosen = docs.filter(F.col("lang").isNotNull()).join(F.broadcast(sample.select("doc_id").distinct()), "doc_id")
    got = sampling.fitting(chosen.select("lang", "doc_id", "text"), seed).mapInArrow(_featurise, "lang string, doc_id bigint, buckets array<int>, counts array<int>").toArrow()
    columns = [got.column(c).combine_chunks() for c in ("lang", "doc_id", "buckets", "counts")] if got.num_rows else []
    if not columns:
        return None
    langs, ids = columns[0].to_pylist(), columns[1].to_pylist()
    samples = [(langs[i], columns[2][i].values.to_numpy(), columns[3][i].values.to_numpy()) for i in sorted(range(len(langs)), key=lambda i: (ids[i], langs[i]))]
    rng = np.random.default_rng(seed)
    return train([samples[i] for i in rng.permutation(len(samples))], seed=seed)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents' doc_id with lang_pred, score (calibrated probability) and rejected.

    A text that is null, empty or without letters, and any text if there is no model,
    is ``und`` with score 0 and rejected.  Long texts are read whole.  Repeated rows
    give repeated results, other columns are ignored, an empty table gives no rows.
    """
    names = np.array([*(model.languages if model else []), UNDETERMINED], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                n = part.num_rows
                best, score, rejected = np.full(n, len(names) - 1), np.zeros(n), np.ones(n, bool)
                if model:
                    logits, letters, unusual = model.logits(data, offsets)
                    p = model.probabilities(logits)
                    known = letters > 0
                    best[known], score[known] = p.argmax(axis=1)[known], p.max(axis=1)[known]
                    rejected = ~known | unusual
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def keep_identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of documents, all columns, whose text is not rejected; without a model every text with a letter stays, as nothing tells it apart."""
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                _, letters, unusual = model.logits(data, offsets)
                yield part.filter(pa.array((letters > 0) & ~unusual))

    return documents.mapInArrow(run, schema) if model else documents.filter(F.col("text").cast("string").rlike(r"\p{L}"))
