"""Dictionary entries in use: pairs that are applied, hints that are only shown, and candidates from rules and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candidates import is_candidate

#: Sections whose entries are hints, in the order in which hints are shown; sensitive pairs come last (fixed values).
HINT_SOURCES = {"review": "review_pairs", "ambiguous": "ambiguous_pairs", "context": "context_sensitive_pairs"}
SENSITIVE = "high_confidence_context_sensitive"


def pairs(entries: DataFrame) -> DataFrame:
    """``lang, raw, pair_norm``: high-confidence entries that don't depend on context.

    Of entries that repeat a raw form, the most frequent stays, then the one
    that sorts first. Entries without a norm are left out.
    """
    sure = entries.where("section = 'high' and norm is not null and not coalesce(flagged, false)")
    best = F.min(F.struct((-F.coalesce("count", F.lit(0))).alias("n"), "norm")).alias("m")
    return sure.groupBy("lang", "raw").agg(best).select("lang", "raw", F.col("m.norm").alias("pair_norm"))


def hints(entries: DataFrame, most: int = 5) -> DataFrame:
    """``lang, raw, hints``: up to ``most`` pieces of evidence (source, norm, count, raw_total) for forms that need a look.

    Entries for review, ambiguous ones and those that depend on context come in
    this order, then pairs of high confidence that depend on context.
    """
    named = list(HINT_SOURCES)
    place = F.when(F.col("section").isin(named), F.array_position(F.array(*map(F.lit, named)), F.col("section")))
    place = place.when((F.col("section") == "high") & F.coalesce("flagged", F.lit(False)), len(named) + 1)
    source = F.element_at(F.array(*map(F.lit, [*HINT_SOURCES.values(), SENSITIVE])), F.col("place").cast("int"))
    w = Window.partitionBy("lang", "raw").orderBy("place", F.coalesce("count", F.lit(0)).desc(), "norm")
    kept = entries.withColumn("place", place).where("place is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    shown = F.struct("k", source.alias("source"), "norm", "count", "raw_total")
    made = kept.groupBy("lang", "raw").agg(F.array_sort(F.collect_list(shown)).alias("h"))
    return made.select("lang", "raw", F.transform("h", lambda x: x.dropFields("k")).alias("hints"))


def apply_pairs(tokens: DataFrame, found: DataFrame, protected: Column) -> DataFrame:
    """Tokens with ``pred`` and ``changed``: a pair's norm unless the token is protected."""
    joined = tokens.join(found, ["lang", "raw"], "left")
    use = F.col("pair_norm").isNotNull() & ~F.coalesce(protected, F.lit(False))
    out = joined.withColumn("pred", F.when(use, F.col("pair_norm")).otherwise(F.col("raw")))
    return out.withColumn("changed", F.col("pred") != F.col("raw")).drop("pair_norm")


def with_candidates(tokens: DataFrame, found: DataFrame, following: str | None = None, final: Column | None = None) -> DataFrame:
    """Tokens with ``hints`` (null where there are none) and ``candidate``: the language's rules name it, or it has hints."""
    joined = tokens.join(found.select("lang", "raw", "hints"), ["lang", "raw"], "left")
    return joined.withColumn("candidate", is_candidate(following=following, final=final) | F.col("hints").isNotNull())


def hint_text(column: str = "hints") -> Column:
    """Hints as the JSON that a prompt shows; null where there are none."""
    return F.when(F.size(column) > 0, F.to_json(column))
