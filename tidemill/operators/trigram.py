"""Substring search by an index of three-character grams.

Rows are kept in blocks by a hash of their key, and for each gram of a row's text the index
has (gram, block, key), sorted by gram so that a search reads few row groups.  A search
looks up its rarest grams, keeps the keys that have them all, reads the blocks of these
keys only and checks the whole text there, since grams can stand apart.  Texts end in two
marks, so that every character begins a gram and terms of one or two characters are looked
up as beginnings of grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialised, scratch

#: Stands after a text; rows in a block, about; blocks at most; grams of a term that are looked up, the rarest ones.
END, ROWS, BLOCKS, LOOKED_UP = "\u0000", 20_000, 4096, 3


@dataclass(frozen=True)
class Index:
    """The rows by block, (gram, block, key) by gram, and how many rows have each gram."""

    rows: DataFrame
    postings: DataFrame
    grams: DataFrame
    key: str


def build(df: DataFrame, key: str, text: Column) -> Index:
    """Index the lower-case ``text`` of every row; a null text is found by nothing but the empty term."""
    spark = df.sparkSession
    blocks = max(1, min(BLOCKS, df.count() // ROWS + 1))
    placed = df.withColumn("_text", F.lower(text)).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    path = f"{scratch(spark)}/searched"
    placed.repartition(min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_block").write.partitionBy("_block").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    padded = F.concat("_text", F.lit(END * 2))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_text")), lambda i: F.substr(padded, i, F.lit(3))))
    postings = rows.filter(F.length("_text") > 0).select(F.explode(grams).alias("gram"), F.col("_block").alias("block"), F.col(key).alias("key"))
    postings = materialised(postings.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram", "key").sortWithinPartitions("gram", "key"), "grams")
    counts = materialised(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "gram-counts")
    return Index(rows, postings, counts, key)


def looked_up(index: Index, term: str) -> list[str]:
    """The grams whose postings answer for a term: its rarest ones (all of which a row must have), or those that begin with it (any of which)."""
    term = term.lower()
    if len(term) < 3:
        return [r["gram"] for r in index.grams.filter(F.col("gram").startswith(term)).select("gram").collect()]  # at most as many as characters squared
    own = sorted({term[i : i + 3] for i in range(len(term) - 2)})
    known = {r["gram"]: r["n"] for r in index.grams.filter(F.col("gram").isin(own)).collect()}
    return sorted(own, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]


def candidates(index: Index, term: str) -> DataFrame:
    """(block, key) of the rows that may hold the term, which has a character at least."""
    grams = looked_up(index, term)
    found = index.postings.filter(F.col("gram").isin(grams))
    if len(term) < 3:
        return found.select("block", "key").distinct()
    return found.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("block", "key")


def search(index: Index, term: str) -> DataFrame:
    """The rows, all columns, whose text holds the term in any case; every row for an empty term."""
    shown = [c for c in index.rows.columns if c not in ("_text", "_block")]
    if not term:
        return index.rows.select(*shown)
    some = candidates(index, term)
    blocks = [r["block"] for r in some.select("block").distinct().collect()]  # at most BLOCKS
    rows = index.rows.filter(F.col("_block").isin(blocks)).filter(F.col("_text").contains(term.lower()))
    return rows.join(some.select(F.col("key").alias(index.key)).distinct(), index.key, "left_semi").select(*shown)
