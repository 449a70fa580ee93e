"""Equi-joins in which a few keys, or missing ones, hold much of the left side.

Keys are counted (within tasks first), and those with more rows than a share of all are
hot: by their very share there can only be so many.  A hot key's left rows are dealt out
over as many salts as it has shares, and only its right rows are replicated, once for each
salt.  Left rows with a null key match nothing and are dealt out over all partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Salts for each share of a hot key: salts are hashed to partitions, and many small ones even out.
FINE = 8
HOWS = ("inner", "left", "left_semi", "left_anti")


def hot_keys(df: DataFrame, on: Sequence[str], share: float) -> DataFrame:
    """(on..., salts): keys with more than ``share`` of the rows, fewer than 1 / share of them, as a local table."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))
    total = df.count()
    found = counts.filter(F.col("n") > share * total).withColumn("salts", F.ceil(F.col("n") / F.lit(max(1.0, share * total))).cast("int")).drop("n")
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", share: float | None = None) -> DataFrame:
    """The rows of ``left.join(right, on, how)`` with hot keys spread over tasks.

    ``share``: of the left rows, above which a key is hot; by default half of a partition's.
    """
    if how not in HOWS:
        raise ValueError(f"no salted join of kind {how!r}; there are {', '.join(HOWS)}")
    on = [on] if isinstance(on, str) else list(on)
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt, salts = "__salt", "__salts"
    hot = hot_keys(left, on, share or 1 / (2 * partitions)).withColumnRenamed("salts", salts)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    hot = hot.withColumn(salts, F.col(salts) * FINE)
    spread = F.when(missing, F.lit(partitions * FINE)).otherwise(F.coalesce(salts, F.lit(1)))
    # By place, not by value: rows that are alike are spread too, and any salt finds the key's right rows.
    hot = F.broadcast(hot)
    dealt = left.join(hot, on, "left").withColumn(salt, F.pmod(F.monotonically_increasing_id(), spread).cast("int")).drop(salts)
    copies = right.filter(~missing).join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    return dealt.join(copies, [*on, salt], how).drop(salt)
