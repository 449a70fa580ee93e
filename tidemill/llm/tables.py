"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Settings while an intermediate table is written: shuffle files are removed when
#: the write ends, and Arrow batches stay small so that a worker holds few texts.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate results: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and everything runs in one process (tests) a
    temporary folder takes its place, and is then kept in the session.  On a cluster a
    missing setting is an error: no folder of one machine is seen by the others.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.isLocal:
            raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.  The
    table goes with the enclosing ``temporary``, or else with the application.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, _WRITING):
        df.write.parquet(path)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


#: Where the tables that are still referred to stand.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def remove(table: DataFrame) -> None:
    """Remove a table that ``written`` or ``stay`` returned; any other DataFrame is left alone."""
    if table in _paths:
        _remove(table.sparkSession, [_paths.pop(table)])


#: Paths by enclosing ``temporary``, innermost last; each thread or task has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those written with ``stay``."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        _remove(spark, own)


def stay(df: DataFrame, name: str) -> DataFrame:
    """Like ``written``, but the table belongs to what encloses the innermost ``temporary``."""
    token = _scopes.set(_scopes.get()[:-1])
    try:
        return written(df, name)
    finally:
        _scopes.reset(token)


_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """This application's own folder, removed when Python ends."""
    app = spark.sparkContext.applicationId
    place = f"{shared_dir(spark)}/tidemill/{app}"
    if _folders.get(app) != place:
        _folders[app] = place
        atexit.register(_forget, spark, place)
    return place


def _forget(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        _remove(spark, [place])


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
