"""Row counts and value ranges of Parquet tables from their footers.

The v2 Parquet reader answers MIN, MAX and COUNT from the statistics of row groups where
nothing filters rows, and can group by partition columns, so what is read is a few KB a
file, whatever the table's size.  Floating-point, text and timestamp columns have no exact
statistics and are read as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import settings

#: Column types whose footers hold the exact least and greatest value.
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)
_READER = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table read through the v2 reader; aggregate it inside ``pushed``."""
    with settings(spark, _READER):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)


def answered(df: DataFrame) -> DataFrame:
    """A small aggregate computed now, while the reader's settings hold; its rows become a local table.

    A file without a single value of a column has no statistics of it; then rows are read.
    """
    spark = df.sparkSession
    try:
        with settings(spark, _READER):
            rows = df.select("*").collect()  # one row for each partition of the table at most
    except Exception as e:
        if "No min/max found" not in str(e):
            raise
        with settings(spark, _READER | {"spark.sql.parquet.aggregatePushdown": "false"}):
            rows = df.select("*").collect()
    # A table without any row group answers with a null count.
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    return spark.createDataFrame(rows, nullable).fillna(0, "rows")


def plan(df: DataFrame) -> str:
    """The executed plan under the reader's settings."""
    with settings(df.sparkSession, _READER):
        fresh = df.select("*")
        return fresh._jdf.queryExecution().executedPlan().toString()


def ranges(df: DataFrame, *columns: str) -> DataFrame:
    """One row: ``rows``, and for each column its least and greatest value as <column>_min and <column>_max."""
    parts: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        if not isinstance(df.schema[c].dataType, EXACT):
            raise ValueError(f"column {c} has no exact statistics")
        parts += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*parts)


def partition_rows(df: DataFrame, *partition_columns: str) -> DataFrame:
    """Rows of each partition."""
    return df.groupBy(*partition_columns).agg(F.count(F.lit(1)).alias("rows"))
