"""A corpus pipeline: language ID, near and substring dedup, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and reread as the next stage's docs.  All
stages but the last return the columns of documents, further ones included; the last
adds to each document what the mix takes of it.

Rows are judged one by one, so null and repeated doc_ids are no special case: a stage
gives rows a key of their own where it has to.  An empty table gives no rows in any
stage.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontam, langid, mixing, neardup, substrings, tables


def _row(docs: DataFrame) -> F.Column:
    """All columns as one struct, so that no name clashes with those that a stage adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; others go, null and empty texts and those without letters too."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the smallest doc_id, nulls last.

    Of rows that also share the doc_id any one stays.  Texts without words are nobody's duplicates.
    """
    rows = tables.written(docs.select(_row(docs).alias("row"), F.monotonically_increasing_id().alias("key")), "keyed-documents")
    found = neardup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "row.text"), size=5, hundredths=80)
    ids = rows.select("key", F.col("row.doc_id").alias("id"))
    labelled = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).join(ids, "key")
    kept = labelled.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select("first.key")
    return rows.join(kept, "key", "left_semi").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that stand in a document of smaller doc_id; emptied documents go.

    n_chars, where documents have it, is counted again for texts that lost words.
    """
    left = substrings.remove_repeats(docs, window=50, with_text=True).filter("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))

    def column(name: str) -> F.Column:
        if name in ("doc_id", "text"):
            return F.col(name).cast(docs.schema[name].dataType)
        return F.coalesce(n_chars, F.col("extra.n_chars")).alias(name) if name == "n_chars" else F.col(f"extra.`{name}`")

    return left.select(*[column(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document, all its columns, with the copies and words that it gives (0 where it is left out)."""
    return mixing.mix(docs, with_columns=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Models, MinHash and sampling are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with tables.temporary(spark):
            docs = tables.stay(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
