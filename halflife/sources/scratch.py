"""Scratch space that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The folders made so far, by application; and those of the scopes that are open, the innermost last.
_made: dict[str, list[str]] = {}
_scopes: list[list[str]] = []

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="halflife-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master may go without the setting; it then gets a temporary folder of its own.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one. It goes with the scope it was made in, or by release(), or when the driver ends."""
    path = f"{shared_dir(spark)}/halflife/{name}-{uuid.uuid4().hex}"
    held = _made.setdefault(spark.sparkContext.applicationId, [])
    if not held:
        atexit.register(_end, spark)
    held.append(path)
    if _scopes:
        _scopes[-1].append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    held = _made.get(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        held.remove(path)


def _end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the driver does
        release(spark)


def release(spark: SparkSession) -> None:
    """Removes all scratch of the application; no result that was read from it may be in use."""
    _delete(spark, list(_made.get(spark.sparkContext.applicationId, [])))


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is made inside goes at the end; tables that stored() makes with keep=True stay."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside go at once, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str | None = None, keep: bool = False) -> DataFrame:
    """df, written once to the shared folder and read from there.

    Cuts the lineage: a lost executor costs a new read and not a new computation, and every later
    use sees the same rows. What the query shuffled goes when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if keep and _scopes:
        _scopes[-1].remove(path)
    with _shuffles_go(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
