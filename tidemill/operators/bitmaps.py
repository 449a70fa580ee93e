"""Exact distinct counts and membership of padded ids by bitmaps, without shuffling keys.

An id such as ORD-0000012 is a number with a fixed prefix.  If every id of a table has that
form, key and number stand for each other, and a table's keys are a set of bits: one bitmap
of 32,768 bits for each bucket of numbers, built within each task before anything is
shuffled.  A bucket with more rows than bits holds a repeated key; a bucket in which the
parent's and the child's bits together outnumber the parent's holds an orphan.  Only the
rows of such buckets are compared key by key, and ids of any other form are too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that may be named in a filter; where more are in question every row is compared.
NAMED = 10_000


@dataclass(frozen=True)
class KeySet:
    """A column of ids, under a name of its own."""

    name: str
    rows: DataFrame
    key: str


@dataclass(frozen=True)
class Form:
    """A prefix, and the digits to which numbers are padded."""

    prefix: str
    width: int

    def number(self, key: str = "id") -> Column:
        """The number of an id of this form, null for any other: no two ids have the same."""
        digits = F.substring(F.col(key), len(self.prefix) + 1, 18)
        exact = F.col(key).startswith(self.prefix) & digits.rlike(r"^\d+$") & (F.length(key) == len(self.prefix) + F.length(digits))
        padded = (F.length(digits) == self.width) | ((F.length(digits) > self.width) & ~digits.startswith("0"))
        return F.when(exact & padded, digits.try_cast("long"))


def forms(sets: Sequence[KeySet]) -> dict[str, Form]:
    """The form of each set's smallest id, all in one job; sets whose smallest id has none are left out."""
    least = _union([s.rows.agg(F.min(s.key).alias("id")).select(F.lit(s.name).alias("set"), "id") for s in sets])
    parts = least.select("set", F.regexp_extract("id", r"^(.*?)(\d+)$", 1).alias("prefix"), F.length(F.regexp_extract("id", r"^(.*?)(\d+)$", 2)).alias("width"))
    return {r["set"]: Form(r["prefix"], r["width"]) for r in parts.collect() if r["width"] and r["width"] <= 18}


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _tagged(s: KeySet, form: Form | None) -> DataFrame:
    """(set, id, number, bucket): number and bucket null where the id has no form."""
    number = form.number() if form else F.lit(None).cast("long")
    ids = s.rows.select(F.col(s.key).alias("id"))
    return ids.select(F.lit(s.name).alias("set"), "id", number.alias("number")).withColumn("bucket", F.bitmap_bucket_number("number"))


def _bits(df: DataFrame, *more: Column) -> DataFrame:
    """(set, bucket, bits, ...) of the rows with a number."""
    return df.filter(F.col("bucket").isNotNull()).groupBy("set", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), *more)


def _in_question(df: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of the given (set, bucket) pairs, and rows without bucket."""
    named = buckets.select("set", "bucket").limit(NAMED + 1).collect()
    if len(named) > NAMED:
        return df
    by_set: dict[str, list[int]] = {}
    for r in named:
        by_set.setdefault(r["set"], []).append(r["bucket"])
    some = [(F.col("set") == name) & F.col("bucket").isin(numbers) for name, numbers in by_set.items()]
    return df.filter(reduce(lambda a, b: a | b, some, F.col("bucket").isNull()))


def repeated_keys(sets: Sequence[KeySet]) -> DataFrame:
    """(set, rows, distinct_keys, repeated_keys) of several tables in one pass; a null key is a key, and no distinct one."""
    form = forms(sets)
    tagged = _union([_tagged(s, form.get(s.name)) for s in sets])
    buckets = _bits(tagged, F.count(F.lit(1)).alias("rows")).select("set", "bucket", "rows", F.bitmap_count("bits").alias("distinct"))
    checked = _in_question(tagged, buckets.filter("rows > distinct"))
    twice = checked.groupBy("set", "id").agg(F.count(F.lit(1)).alias("n"))
    odd = twice.groupBy("set").agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    regular = buckets.groupBy("set").agg(F.sum("rows").alias("rows"), F.sum("distinct").alias("distinct"))
    other = tagged.filter("bucket is null").groupBy("set", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("set").agg(F.sum("n").alias("other_rows"), F.count("id").alias("other_distinct"))
    names = sets[0].rows.sparkSession.createDataFrame([(s.name,) for s in sets], "set string")
    out = names.join(F.broadcast(regular), "set", "left").join(F.broadcast(other), "set", "left").join(F.broadcast(odd), "set", "left")  # one row for each set
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("set", (zero("rows") + zero("other_rows")).alias("rows"), (zero("distinct") + zero("other_distinct")).alias("distinct_keys"), zero("repeated_keys").alias("repeated_keys"))


def orphan_rows(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """(key, n): the child's keys without a parent, and how often each occurs; null keys are left out."""
    parent_key = parent_key or key
    sets = [KeySet("parent", parent, parent_key), KeySet("child", child.filter(F.col(key).isNotNull()), key)]
    # One form for both: ids of different forms with the same number are not the same.
    form = forms(sets[:1]).get("parent")
    own, other = _tagged(sets[1], form), _tagged(sets[0], form)
    pairs = _bits(own.unionByName(other)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("both"), F.bitmap_or_agg(F.when(F.col("set") == "parent", F.col("bits"))).alias("parents"))
    lost = pairs.filter(F.bitmap_count("both") > F.coalesce(F.bitmap_count("parents"), F.lit(0))).select(F.lit("child").alias("set"), "bucket")
    suspects = _in_question(own, lost).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return suspects.join(other.select("id"), "id", "left_anti").select(F.col("id").alias(key), "n")
