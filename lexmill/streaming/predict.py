"""Prediction over a stream of sentences, joined with static statistics.

The joins are stream-static, so there is no state and no watermark; each
micro-batch is written with its tokens' keys, and a repeated batch replaces
its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cascade, ngram, replace, tokens

SENTENCE = "row_id bigint, lang string, raw array<string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SENTENCE).json(path)


def predict(sentences: DataFrame, levels: dict[str, DataFrame], stats: DataFrame, config: ngram.Config = ngram.Config()) -> DataFrame:
    """Token rows with ``pred``; works on a stream and on a table."""
    rows = tokens.explode(sentences.withColumn("norm", F.col("raw")))
    made = replace.guard_two(ngram.predict(rows, levels, config), stats).withColumnRenamed("pred", "mfr_pred")
    return made.select("row_id", "tok_idx", "lang", "raw", "source", cascade.cascade("tri_pred", "mfr_pred").alias("pred"))


def write(predicted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return predicted.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
