"""Few-shot retrieval: training sentences with a token like the target.

A target's examples are the sentences with the smallest edit distance between
the target and one of their changed (or unchanged) tokens; ties go to the
sentence most like the target's, then to the first. Sentences are text columns
and their distance is computed only for rows that reach the last place, so the
costly distance stays off the long tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool(tokens: DataFrame, positive: bool = True) -> DataFrame:
    """``lang, form, row_id, at``: each form of a sentence once, where it first stands."""
    changed = F.col("raw") != F.col("norm")
    rows = tokens.where(changed if positive else ~changed)
    return rows.groupBy("lang", F.col("raw").alias("form"), "row_id").agg(F.min("tok_idx").alias("at"))


def retrieve(targets: DataFrame, pooled: DataFrame, sentences: DataFrame, k: int = 3, block: int = 64) -> DataFrame:
    """``target_id, rank, row_id, at, dist, score`` from ``target_id, lang, form, text`` and ``row_id, text``.

    Distances are between distinct forms of a language, of which only the
    nearest ``k`` sentences' worth go on: forms are ranked by distance, and a
    form whose nearer ones hold ``k`` sentences already is left out.
    """
    if k <= 0:
        return targets.sparkSession.createDataFrame([], "target_id bigint, rank int, row_id bigint, at int, dist int, score double")
    wanted = targets.select("lang", "form").distinct()
    forms = pooled.groupBy("lang", F.col("form").alias("near")).agg(F.count("*").alias("held"))
    spread = forms.withColumn("slice", F.pmod(F.xxhash64("near"), F.lit(block)))
    every = wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    scored = every.join(spread, ["lang", "slice"]).select("lang", "form", "near", "held", F.levenshtein("form", "near").alias("dist"))
    # Within a slice, then over slices: the forms that can still matter are few after the first.
    for keys in (["lang", "form", "slice"], ["lang", "form"]):
        if "slice" in keys:
            scored = scored.withColumn("slice", F.pmod(F.xxhash64("near"), F.lit(block)))
        before = Window.partitionBy(*keys).orderBy("dist").rangeBetween(Window.unboundedPreceding, -1)
        scored = scored.withColumn("b", F.coalesce(F.sum("held").over(before), F.lit(0))).where(F.col("b") < k)
    near = scored.select("lang", "form", "near", "dist")
    rows = targets.join(near, ["lang", "form"]).join(pooled.withColumnRenamed("form", "near"), ["lang", "near"])
    best = rows.groupBy("target_id", "text", "row_id").agg(F.min(F.struct("dist", "at")).alias("m"))
    sized = best.join(sentences.select("row_id", F.col("text").alias("other")), "row_id")
    longest = F.greatest(F.length("text"), F.length("other"), F.lit(1))
    score = F.when(F.col("text").isNull(), 0.0).otherwise(F.levenshtein("text", "other") / longest)
    w = Window.partitionBy("target_id").orderBy("dist", "score", "row_id")
    ranked = sized.select("target_id", "row_id", "m.dist", "m.at", score.alias("score")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)
