"""Sentences and tokens: the two physical forms, and the way between them.

Sentences hold aligned arrays; tokens are rows. Neighbours are taken by array
position before exploding, so they cost no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BOS, EOS, lang_code

#: Positions of tokens in a corpus: row_id * ROOM + tok_idx.
ROOM = 10_000_000


def derived_sentences(documents: DataFrame) -> DataFrame:
    """Sentences ``row_id, lang, raw, norm, val`` made from documents: norm is the text's tokens, raw a quarter of them degraded."""
    toks = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("row_id"), "lang", toks.alias("norm"))
    worn = lambda x: F.translate(F.lower(x), "éèêàçôäöüßñáíóú", "eeeacoaousnaiou")
    raw = F.transform("norm", lambda x, i: F.when((F.col("row_id") * 31 + i) % 4 == 0, worn(x)).otherwise(x))
    return docs.select("row_id", "lang", raw.alias("raw"), "norm", (F.col("row_id") % 5 == 0).alias("val"))


def explode(sentences: DataFrame, *extra: str) -> DataFrame:
    """Token rows ``row_id, lang, n_tok, tok_idx, raw, norm, prev, next`` and the extra columns; sentences of other lengths must be aligned before."""
    pair = F.posexplode(F.arrays_zip("raw", "norm"))
    before, after = F.get("raws", F.col("tok_idx") - 1), F.get("raws", F.col("tok_idx") + 1)
    rows = sentences.select("row_id", "lang", *extra, F.col("raw").alias("raws"), pair.alias("tok_idx", "p"))
    return rows.select(
        "row_id", "lang", *extra, F.size("raws").alias("n_tok"), "tok_idx", "p.raw", "p.norm",
        F.coalesce(before, F.lit(BOS)).alias("prev"), F.coalesce(after, F.lit(EOS)).alias("next"),
    )


def reassemble(tokens: DataFrame, *values: str) -> DataFrame:
    """Arrays in token order, one row a sentence."""
    made = tokens.groupBy("row_id", "lang").agg(F.array_sort(F.collect_list(F.struct("tok_idx", *values))).alias("t"))
    part = lambda v: F.transform("t", lambda x: x.getField(v)).alias(v)
    return made.select("row_id", "lang", *map(part, values))


def align(sentences: DataFrame, mode: str = "strict") -> DataFrame:
    """Sentences whose arrays have one length: ``strict`` raises on others, ``skip`` leaves them out, ``pad`` fills norm with raw tokens or cuts it."""
    same = F.size("raw") == F.size("norm")
    if mode == "skip":
        return sentences.where(F.coalesce(same, F.lit(False)) & (F.size("raw") > 0))
    if mode == "pad":
        filled = F.transform("raw", lambda x, i: F.coalesce(F.get("norm", i), x))
        return sentences.where("raw is not null").withColumn("norm", filled)
    if mode == "strict":
        checked = F.when(same, F.col("norm")).otherwise(F.raise_error(F.concat(F.lit("raw and norm differ in length in row "), F.col("row_id").cast("string"))))
        return sentences.withColumn("norm", checked)
    raise ValueError(f"no such mode: {mode}")


def with_lang_code(df: DataFrame, column: str = "lang") -> DataFrame:
    return df.withColumn(column, lang_code(F.col(column)))


def position() -> Column:
    return F.col("row_id") * ROOM + F.col("tok_idx")


def changed_positions(raw: str = "raw", norm: str = "norm") -> Column:
    """Indices where the arrays differ."""
    return F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: F.get(raw, i) != F.get(norm, i))
