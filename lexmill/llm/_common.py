"""Helpers shared by the training-data operators: tables, durable cuts and Arrow mapping."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED = "/tmp/checkpoints"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from the session's ``spark.checkpoint.dir``; only a local-mode
    session without one (tests) gets a default.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return _LOCAL_SHARED
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at the written files, so a lost executor costs a re-read and
    no recomputation, and later stages see real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    if df is None:
        return
    for name in df.inputFiles()[:1]:
        path = name.rsplit("/", 1)[0]
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if not path.endswith(x[1].rsplit("/", 1)[1])]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  that session has ended: the shared folder's owner cleans it
            continue


#: Keys that ``attach`` may broadcast: those of at least one in so many rows, so there can be no more of them.
HOT_KEYS = 200_000


def attach(rows: DataFrame, few: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined, from the left, with the columns that ``few`` has for their key.

    ``few`` has a row a key, with the number of ``rows`` of it in ``count``
    (left out of the result); ``total`` is the number of all rows. Keys of
    more than ``total / HOT_KEYS`` rows, of which there are fewer than
    ``HOT_KEYS``, are broadcast, so that no task gets a hot key's rows; the
    rest is shuffled.
    """
    least = total // HOT_KEYS + 64
    hot = F.broadcast(few.where(F.col(count) > least).drop(count))
    cold = few.where(F.col(count) <= least).drop(count)
    often = rows.join(hot, key)
    return often.unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


#: Rows and bytes of an Arrow batch of texts: what a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't fill a worker's memory; lower settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def map_arrow(
    df: DataFrame,
    columns: list,
    schema: str,
    start: Callable[[], Callable[[list[list]], list[list]]],
) -> DataFrame:
    """Run a batch function over some columns of ``df`` in Arrow batches.

    ``columns`` are Column expressions, handed to Python as lists in that order,
    so other columns of the input can have any names. ``start`` is called once
    a task and returns the function from lists in to lists out.
    """
    bound_batches(df.sparkSession)
    narrow = df.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
    arrow = _arrow_schema(narrow.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or start()
            out = step([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow
            )

    return narrow.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
