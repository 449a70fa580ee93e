"""Working folders in the place that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .versioned import Files

_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and everything runs in one process, a temporary folder.

    On a cluster a missing setting is an error, since no other machine sees a local folder.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.isLocal:
            raise ValueError("spark.checkpoint.dir is not set; working folders have to be seen by all executors")
        place = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new working folder of this application, removed when Python ends."""
    own = f"{shared_folder(spark)}/scratch/{spark.sparkContext.applicationId}"
    if own not in _made:
        _made.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by now
        Files(spark, path).remove(path)


@contextlib.contextmanager
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


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a working folder and read again: computed once, however often it is used."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
