"""Tables that several jobs need, written to the folder that driver and executors share.

A table written there is read by short plans and survives lost executors; a cache or a local checkpoint does neither.
What a round of an iteration wrote is discarded when the next has been written; a ``scratch`` scope discards the rest.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a temporary one only for local masters."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tersa-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str, outlive: bool = False) -> str:
    """A new name in the shared folder; what is put there goes with the scope around, if there is one, or with the next one out."""
    path = f"{shared_dir(spark)}/tersa-{label}-{uuid.uuid4().hex}"
    for scope in _scopes[-2:-1] if outlive else _scopes[-1:]:
        scope.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, outlive: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = fresh_path(spark, label, outlive)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tersa_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialize() wrote for these tables; nothing may read them any more."""
    for t in tables:
        if path := getattr(t, "_tersa_path", None):
            delete(t.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Everything written to the shared folder within is deleted at the end; results must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            delete(spark, path)
