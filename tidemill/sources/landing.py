"""Raw files into tables: scans, landing copies, external tables, full refreshes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .schemas import STREAMS, TABLES, column_types
from .versioned import Files, Store


class SourceMissing(FileNotFoundError):
    """A raw file is not there; the text says which."""


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet source; SourceMissing if it is not there, ValueError for a column of a type no table may have."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise SourceMissing(f"no raw data at {path}; run the generator (sources.generator.write_dataset) first") from e
        raise
    column_types(df)
    return df


def land(df: DataFrame, root: str, table: str) -> str:
    """An unchanged copy of a source in the landing area; a second copy replaces the first."""
    path = f"{root}/{table}"
    df.write.mode("overwrite").parquet(path)
    return path


def create_databases(spark: SparkSession, *names: str) -> None:
    for n in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{n}`")


def external_table(spark: SparkSession, database: str, table: str, path: str) -> None:
    """A catalog table over a folder, dropped and made anew; the files are not touched."""
    create_databases(spark, database)
    spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{table}`")
    spark.sql(f"CREATE TABLE `{database}`.`{table}` USING parquet LOCATION '{path}'")


def ingest(spark: SparkSession, source: str, landing: str, store: Store, table: str) -> int:
    """Source to landing to bronze table; the rows of the new version are returned."""
    path = land(scan(spark, f"{source}/{table}"), landing, table)
    store.write(f"bronze.{table}", spark.read.parquet(path))
    return store.read(f"bronze.{table}").count()


def ingest_all(spark: SparkSession, source: str, landing: str, store: Store) -> dict[str, int]:
    return {t: ingest(spark, source, landing, store, t) for t in TABLES}


def bronze_reader(spark: SparkSession, store: Store, stream_root: str | None = None):
    """A reader of raw tables: versions from the store, streams from their appended tables."""
    from ..streaming.ingest import read_table, stream_specs
    from .schemas import schema

    def read(name: str) -> DataFrame | None:
        layer, _, table = name.partition(".")
        if layer != "bronze":
            return None
        if table.startswith("stream_") and table[7:] in STREAMS:
            return read_table(spark, stream_specs(stream_root)[table[7:]]) if stream_root else spark.createDataFrame([], schema(table[7:]))
        return store.read(name)

    return read


def catalog_tables(spark: SparkSession, database: str) -> DataFrame:
    """(database, table, column_name, data_type) of a database, as an information schema has it."""
    rows = [(database, t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) if t.tableType != "TEMPORARY" for c in spark.catalog.listColumns(t.name, database)]
    return spark.createDataFrame(rows, "database string, table_name string, column_name string, data_type string")


def round_trip(spark: SparkSession, root: str) -> list[tuple]:
    """Write literal rows, read them with their types and remove them: a check that storage works."""
    path = f"{root}/round_trip"
    spark.createDataFrame([(1, "a", 1.5), (2, None, -2.0)], "id int, name string, x double").write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    out = [tuple(r) for r in df.orderBy("id").collect()] + [tuple(df.dtypes)]
    Files(spark, path).remove(path)
    return out


def list_objects(spark: SparkSession, prefix: str) -> DataFrame:
    """(path, bytes) of every object below a prefix."""
    return spark.createDataFrame([(p, n) for p, n, _ in Files(spark, prefix).listing(prefix)], "path string, bytes bigint")


def purge(spark: SparkSession, prefix: str) -> int:
    """Remove everything below a prefix; the number of objects is returned."""
    files = Files(spark, prefix)
    n = len(files.listing(prefix))
    files.remove(prefix)
    return n
