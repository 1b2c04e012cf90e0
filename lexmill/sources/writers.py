"""Writers of statistics, logs, metrics and submissions."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def statistics(df: DataFrame, path: str) -> None:
    """Statistics as Parquet, a folder a language, so a reader takes only the languages it needs."""
    df.write.mode("overwrite").partitionBy("lang").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a JSON-lines log."""
    df.write.mode("append").json(path)


def predictions(df: DataFrame, path: str) -> None:
    """``raw, norm (blank), lang, pred`` as JSON lines in row order."""
    blank = F.transform("raw", lambda x: F.lit(""))
    df.orderBy("row_id").select("raw", blank.alias("norm"), "lang", "pred").write.mode("overwrite").json(path)


def metrics_csv(frames: list[DataFrame], path: str) -> None:
    """Metric tables under one another as CSV; columns in the order in which they first come, missing values empty; no tables give an empty file."""
    if not frames:
        SparkSession.active().createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.select(*names).coalesce(1).write.mode("overwrite").csv(path, header=True)


def metrics_json(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines, null fields kept."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def submission_zip(df: DataFrame, path: str) -> int:
    """A zip with ``predictions.json``, written on the driver row by row; the number of sentences."""
    blank = F.transform("raw", lambda x: F.lit(""))
    rows, n = df.orderBy("row_id").select("raw", blank.alias("norm"), "lang", "pred"), 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("predictions.json", "w") as raw, io.TextIOWrapper(raw, "utf-8") as out:
        out.write("[")
        for row in rows.toLocalIterator():
            out.write(",\n" if n else "\n")
            json.dump(row.asDict(), out, ensure_ascii=False)
            n += 1
        out.write("\n]\n")
    return n
