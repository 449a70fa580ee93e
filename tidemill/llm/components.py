"""Connected components of links between ids, by contraction.

In each round every id adopts the smallest id among its neighbours and itself, that
choice is followed to its end for two steps, and links are rewritten to the chosen
ids; links inside one id vanish.  Links at least halve in depth, so the rounds grow
with the logarithm of the longest chain.  Links and labels stay in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): component is the smallest id reachable."""
    spark = links.sparkSession
    edges = tables.written(links.select(F.col("a").cast("long").alias("low"), F.col("b").cast("long").alias("high")).filter("low <> high").distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        parent = both.groupBy(F.col("low").alias("id")).agg(F.min("high").alias("least")).select("id", F.least("id", "least").alias("p"))
        parent = tables.written(parent, "parents")
        up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        parent = tables.written(parent.join(up, "p").select("id", F.col("pp").alias("p")), "parents")
        steps.append(parent)
        one = parent.select(F.col("id").alias("low"), F.col("p").alias("p1"))
        other = parent.select(F.col("id").alias("high"), F.col("p").alias("p2"))
        edges = tables.written(edges.join(one, "low").join(other, "high").select(F.least("p1", "p2").alias("low"), F.greatest("p1", "p2").alias("high")).filter("low <> high").distinct(), "links")
    if not steps:
        return spark.createDataFrame([], "id bigint, component bigint")
    # Compose the rounds from the last: an id's component is its choice's component.
    found = steps[-1].select("id", F.col("p").alias("component"))
    for step in reversed(steps[:-1]):
        later = found.withColumnRenamed("id", "p").withColumnRenamed("component", "c")
        found = step.join(later, "p", "left").select("id", F.coalesce("c", "p").alias("component"))
    return found
