"""Tables that are written and read again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a default."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return "/tmp/checkpoints"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each action's shuffle files are removed when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)


def in_parts(spark: SparkSession, make: Callable[[int], DataFrame], parts: int) -> DataFrame:
    """All rows of ``make(0)`` to ``make(parts - 1)``, each written before the next begins.

    So the shuffle of one part only lies on disk at a time. The files are
    deleted when the process ends, or by ``last_only``.
    """
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    _written.append((spark, path))
    with _shuffles_removed(spark):
        for k in range(parts):
            made = make(k)
            made.write.parquet(f"{path}/{k}")
    return spark.read.schema(made.schema).parquet(*[f"{path}/{k}" for k in range(parts)])


def once(spark: SparkSession, made: DataFrame) -> DataFrame:
    """The rows, written and read again; their shuffle is removed."""
    return in_parts(spark, lambda _: made, 1)


@contextmanager
def last_only() -> Iterator[None]:
    """Of the tables written inside, all but the last are deleted when it ends: nothing outside may read them."""
    begun = len(_written)
    yield
    over = _written[begun:-1]
    del _written[begun:-1]
    _delete(over)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  that session has ended: the shared folder's owner cleans it
            continue


@atexit.register
def _clean() -> None:
    _delete(_written)
