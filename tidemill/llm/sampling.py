"""Bounded, repeatable samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Labels that a model may have, the most frequent ones, and characters of all texts that it is fitted on, about.
MOST_LABELS, CHARACTERS = 1024, 60_000_000


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32(doc_id as text) mod 5 = 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def draw(doc_id: Column, seed: int) -> Column:
    """A value in [0, 1) for a document, the same in every run."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def bounded(labelled: DataFrame, label: str, rows: int, seed: int, per_label: bool) -> DataFrame:
    """(doc_id, label) rows of about ``rows`` documents in all, or of each label.

    The counts by label are the only thing that reaches the driver; of more than
    MOST_LABELS labels the most frequent ones are sampled.
    """
    labelled = labelled.select(F.col("doc_id"), F.col(label)).filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS).collect()}
    total = sum(counts.values())
    share = {k: min(1.0, rows / (n if per_label else total)) for k, n in counts.items()}
    keep = F.lit(False)
    for fraction in sorted(set(share.values())):
        names = [k for k, v in share.items() if v == fraction]
        keep = keep | (F.col(label).isin(names) & (draw(F.col("doc_id"), seed) < fraction))
    return labelled.filter(keep)


def fitting(documents: DataFrame, seed: int, characters: int = CHARACTERS) -> DataFrame:
    """Sampled documents, or so many of them that their texts have about ``characters`` in all."""
    total = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    return documents if total <= characters else documents.filter(draw(F.col("doc_id"), seed + 1) < characters / total)
