"""Composite operators: source merges, keep-first, anti-joins, filters, one-row joins."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; the planner limits groups before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def ranked_union(batch: DataFrame, stream: DataFrame) -> DataFrame:
    """All rows of both sources, with src_rank 1 for batch and 2 for stream."""
    return batch.withColumn("src_rank", F.lit(1)).unionByName(stream.withColumn("src_rank", F.lit(2)))


def merge_sources(batch: DataFrame, stream: DataFrame, key: str, then: Iterable[str] = ()) -> DataFrame:
    """Batch and stream as one table with a row for each key; the batch row wins."""
    return keep_first(ranked_union(batch, stream), [key], ["src_rank", *then]).drop("src_rank")


def total_rows(df: DataFrame, name: str = "n", keys: Sequence[str] = (), times: str = "_times") -> DataFrame:
    """The number of rows, by ``keys`` if there are any; where the column ``times`` says how many each stands for, their sum."""
    n = F.coalesce(F.sum(times), F.lit(0)).cast("long") if times in df.columns else F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias(name)) if keys else df.agg(n.alias(name))


def times(df: DataFrame, money: str, weight: str = "_times") -> Column:
    """An amount, as often as its row stands for."""
    return F.col(money) * F.col(weight).cast("decimal(10,0)") if weight in df.columns else F.col(money)


def orphans(child: DataFrame, parent: DataFrame, key: str, nullable: bool = False) -> DataFrame:
    """Child rows without a parent; a null key counts as an orphan unless ``nullable``."""
    if nullable:
        child = child.filter(F.col(key).isNotNull())
    return child.join(parent.select(key).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return total_rows(df, keys=keys).filter("n > 1")


def all_of(predicates: Iterable[Column]) -> Column:
    """Conjunction; true if there are no predicates."""
    return reduce(operator.and_, predicates, F.lit(True))


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the values of a one-row aggregate, which is small by construction."""
    return df.crossJoin(F.broadcast(one_row))


def count_where(p: Column) -> Column:
    return F.count_if(p).cast("long")


def sum_where(p: Column, x: Column) -> Column:
    """Sum over the rows that satisfy p, 0 without any."""
    return F.coalesce(F.sum(F.when(p, x)), F.lit(0))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def only_in_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right does not have."""
    return left.join(right.select(key).distinct(), key, "left_anti")
