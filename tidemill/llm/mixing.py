"""Mixing sources to target weights by Pareto order sampling.

Documents of source s are wanted e = target(s) / size(s) times on average.  The whole
part of e is certain: that many copies are allocated at once.  The rest, p = e - floor(e),
is drawn with unequal probabilities: longer documents are likelier, as they cost the
mix fewer cuts for the same words.  With z = size / (size + 256), p_i = p + d * (z_i - z'),
where z' is the mean of z over the source's words, so that the expected words are exactly
p * size(s), and d is nine tenths of what keeps every p_i between 0 and 1.  Documents are
ranked by random odds over inclusion odds, q = (u / (1 - u)) / (p_i / (1 - p_i)), and the
sample of a source is the prefix of this order whose words come nearest to the source's
remaining target: its size is fixed in words, not only on average.

DataFrame functions only.  No source is ever sorted as a whole: q / (1 + q) is first put
into bins of equal width, words are summed by (source, bin) with partial sums before the
shuffle, and only the one bin in which the target is reached is ordered by document.
The cut lies near q = 1, where a bin holds at most about its even share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tables

#: Bins of the rank order for each source; the ordered bin holds about size / BINS rows.
BINS = 16_384
WEIGHTS = (5.0, 2.0, 1.0)
#: Words at which z is a half; z is counted in whole steps, so that its sums are exact.
HALF, STEPS = 256, 1024
#: Part of the widest possible spread of inclusion probabilities.
SPREAD = 0.9
WORD = r"[^\x20\x09-\x0D]+"


def uniform(key: Column, seed: int) -> Column:
    """A value in (0, 1) from 52 bits of an md5, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources are ordered by code point, null last; weights repeat along that order.
    Together they get ``share`` of all words by weight, none more than ``most`` times
    its own.  That is a water level w with target = min(cap, w * weight): sources
    reach their caps in the order of cap / weight, so running sums give the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("reach", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_to_here", F.sum("cap").over(level))
        .withColumn("weight_to_here", F.sum("weight").over(level))
    )
    # The level if exactly the sources before this one are full; this one is full if it reaches its cap below it.
    before = (F.col("total") - (F.col("cap_to_here") - F.col("cap"))) / (F.col("weights") - F.col("weight_to_here") + F.col("weight"))
    ranked = ranked.withColumn("full", F.col("reach") <= before)
    full_cap = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    water = F.try_divide(F.col("total") - full_cap, open_weight)
    return ranked.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), water * F.col("weight"))).alias("target"))


def mix(documents: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, with_columns: bool = False) -> DataFrame:
    """Copies of each document in the mix: doc_id, source, size, source_size, target, copies, taken.

    size counts the words of the text (null: 0); taken = copies * size.  A null
    source is a source of its own, ordered last.  Documents without words, and all
    documents of a source without words, are taken 0 times.  Rows that repeat a
    doc_id have one random number; among them the order is by size, and equal rows
    are interchangeable.  A null doc_id draws as the word null does.  An empty table
    gives no rows.  With ``with_columns`` all columns of documents come first, and a
    result whose name is among them goes; otherwise other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    carried = ["row"] if with_columns else []
    docs = documents.select("doc_id", "source", size.alias("size"), *([row] if with_columns else []))
    z = F.expr(f"(size * {STEPS}) div (size + {HALF})")
    docs = tables.written(docs.withColumn("z", z), "mixing-sizes")
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("z") * F.col("size")).alias("zs"))
    by_source = targets(sums.select("source", "source_size"), share, most, weights).withColumnRenamed("source", "s")
    by_source = tables.written(by_source.join(sums.select("source", "zs"), F.col("s").eqNullSafe(F.col("source"))).drop("s"), "mixing-targets")
    wanted = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    by_source = by_source.withColumn("whole", F.floor(wanted).cast("long")).withColumn("p", wanted - F.floor(wanted))
    by_source = by_source.withColumn("mean", F.try_divide(F.col("zs").cast("double"), F.col("source_size") * F.lit(float(STEPS))))
    by_source = by_source.withColumn("d", F.lit(SPREAD) * F.least(F.try_divide("p", "mean"), F.try_divide(1 - F.col("p"), 1 - F.col("mean")))).drop("zs")
    known = docs.withColumnRenamed("source", "s").join(by_source, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    u = uniform(F.col("doc_id"), seed)
    p = F.col("p") + F.col("d") * (F.col("z") / F.lit(float(STEPS)) - F.col("mean"))
    q = (u / (1 - u)) * ((1 - p) / p)
    known = known.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), q)).withColumn("bin", F.when(F.col("q").isNotNull(), F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int")))
    rest = (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")
    bins = known.filter(F.col("bin").isNotNull()).groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first(rest).alias("rest"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        bins.withColumn("to_here", F.sum("words").over(running))
        .filter((F.col("to_here") - F.col("words") < F.col("rest")) & (F.col("to_here") >= F.col("rest")))
        .groupBy("source")
        .agg(F.min("bin").alias("edge"), F.min(F.col("to_here") - F.col("words")).alias("below"))
    )
    edge = tables.written(edge, "mixing-edge").withColumnRenamed("source", "s")
    known = known.join(edge, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
    in_edge = F.col("bin") == F.col("edge")
    inside = known.filter(in_edge)
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("below") + F.sum("size").over(order)
    room = F.col("target") - F.col("whole") * F.col("source_size")
    # A document is in while the words so far stay nearer to the target with it than without it.
    inside = inside.withColumn("drawn", (after - room <= room - (after - F.col("size"))).cast("long"))
    outside = known.filter(~F.coalesce(in_edge, F.lit(False))).withColumn("drawn", F.coalesce((F.col("bin") < F.col("edge")), F.col("bin").isNotNull()).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("drawn")).otherwise(F.lit(0)).cast("long")
    both = inside.unionByName(outside).withColumn("copies", copies)
    both = both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried)
    return both.select("row.*", *[c for c in both.columns if c != "row" and c not in documents.columns]) if with_columns else both
