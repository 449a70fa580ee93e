"""Versioned Parquet tables: full refresh without a gap, time travel, maintenance.

A table is a folder with one folder for each version and a pointer to the newest.  A
refresh writes the next version and then moves the pointer, so readers of the version
before are not disturbed.  All file work goes through Hadoop's FileSystem, so tables
may lie in any store that Spark reads.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"
KEEP_BELOW = 3


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    written: float
    files: int
    bytes: int


class Files:
    """The few file operations that tables need."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(p))] if self.exists(p) else []

    def listing(self, p: str) -> list[tuple[str, int, float]]:
        """(path, bytes, time of last change) of all files below a folder."""
        out = []
        if self.exists(p):
            it = self.fs.listFiles(self.path(p), True)
            while it.hasNext():
                s = it.next()
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime() / 1000))
        return out

    def remove(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def write_text(self, p: str, text: str) -> None:
        out = self.fs.create(self.path(p), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Store:
    """Versioned tables under one folder, named layer.table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def folder(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}"

    def current(self, table: str) -> int | None:
        p = f"{self.folder(table)}/{POINTER}"
        return int(self.files.read_text(p)) if self.files.exists(p) else None

    def write(self, table: str, df: DataFrame, partition_by: str | None = None) -> int:
        """Full refresh: the next version, then the pointer. The version's number is returned."""
        number = max([0, *(self._number(n) for n in self.files.names(self.folder(table)))]) + 1
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.folder(table)}/v={number}")
        self.files.write_text(f"{self.folder(table)}/{POINTER}", str(number))
        return number

    def read(self, table: str, version: int | None = None, as_of: float | None = None) -> DataFrame:
        """The newest version, a given one, or the newest written by a time (seconds)."""
        if as_of is not None:
            before = [v.number for v in self.versions(table) if v.written <= as_of]
            if not before:
                raise KeyError(f"{table} has no version of that time")
            version = max(before)
        version = self.current(table) if version is None else version
        if version is None or not self.files.exists(f"{self.folder(table)}/v={version}"):
            raise KeyError(f"no table {table}" if version is None else f"{table} has no version {version}")
        return self.spark.read.parquet(f"{self.folder(table)}/v={version}")

    def tables(self, layer: str) -> list[str]:
        return sorted(f"{layer}.{n}" for n in self.files.names(f"{self.root}/{layer}") if self.files.exists(f"{self.root}/{layer}/{n}/{POINTER}"))

    @staticmethod
    def _number(name: str) -> int:
        return int(name[2:]) if name.startswith("v=") and name[2:].isdigit() else 0

    def versions(self, table: str) -> list[Version]:
        """Complete versions, oldest first."""
        out = []
        for name in self.files.names(self.folder(table)):
            if self._number(name) and self.files.exists(f"{self.folder(table)}/{name}/_SUCCESS"):
                p = f"{self.folder(table)}/{name}"
                listed = self.files.listing(p)
                data = [x for x in listed if x[0].endswith(".parquet")]
                out.append(Version(self._number(name), p, max(x[2] for x in listed), len(data), sum(x[1] for x in data)))
        return sorted(out, key=lambda v: v.number)

    def expire(self, table: str, retention: float, now: float | None = None) -> list[int]:
        """Remove versions older than ``retention`` seconds; the newest stays, and few versions are left alone."""
        known = self.versions(table)
        if len(known) < KEEP_BELOW:
            return []
        limit = (time.time() if now is None else now) - retention
        keep = self.current(table)
        gone = [v for v in known if v.number != keep and v.written < limit]
        for v in gone:
            self.files.remove(v.path)
        return [v.number for v in gone]

    def remove_orphans(self, table: str, retention: float, now: float | None = None) -> dict[str, int]:
        """Remove files of unfinished versions that are older than ``retention`` seconds: counts and bytes."""
        limit = (time.time() if now is None else now) - retention
        complete = {f"v={v.number}" for v in self.versions(table)} | {POINTER}
        files = size = 0
        for name in self.files.names(self.folder(table)):
            listed = self.files.listing(f"{self.folder(table)}/{name}")
            if name not in complete and listed and max(x[2] for x in listed) < limit:
                files, size = files + len(listed), size + sum(x[1] for x in listed)
                self.files.remove(f"{self.folder(table)}/{name}")
        return {"files": files, "bytes": size}

    def compact(self, table: str, file_mb: int = 128) -> int:
        """The newest version again, in files of about ``file_mb``."""
        size = sum(x[1] for x in self.files.listing(f"{self.folder(table)}/v={self.current(table)}"))
        return self.write(table, self.read(table).coalesce(max(1, -(-size // (file_mb << 20)))))

    def drop(self, table: str) -> None:
        self.files.remove(self.folder(table))
