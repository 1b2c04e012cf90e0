"""Context n-gram statistics and back-off prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strong_protect
from .tokens import position

LEVELS = {"tri": ["lang", "prev", "raw", "next"], "biL": ["lang", "prev", "raw"], "biR": ["lang", "raw", "next"]}
VARIANTS = {"pure": (), "tri_biL": ("biL",), "tri_biR": ("biR",), "tri_bi_both": ("biL", "biR")}


@dataclass(frozen=True)
class Config:
    variant: str = "tri_bi_both"
    conf_min: float = 0.70
    protect: bool = False


def counts(tokens: DataFrame, level: str = "tri") -> DataFrame:
    """``<keys>, norm, c, first_pos``: how often a norm follows in a context, and where first."""
    return tokens.groupBy(*LEVELS[level], "norm").agg(F.count("*").alias("c"), F.min(position()).alias("first_pos"))


def roll_up(trigrams: DataFrame, level: str) -> DataFrame:
    """Counts of a shorter context from those of the longer one, without another pass over tokens."""
    return trigrams.groupBy(*LEVELS[level], "norm").agg(F.sum("c").alias("c"), F.min("first_pos").alias("first_pos"))


def best(counted: DataFrame, level: str) -> DataFrame:
    """``<keys>, norm, total, conf``: the most frequent norm of a context; ties go to the one seen first."""
    top = F.min(F.struct((-F.col("c")).alias("n"), "first_pos", "norm")).alias("m")
    made = counted.groupBy(*LEVELS[level]).agg(top, F.sum("c").alias("total"))
    return made.select(*LEVELS[level], F.col("m.norm").alias("norm"), "total", ((-F.col("m.n")) / F.col("total")).alias("conf"))


def tables(tokens: DataFrame) -> dict[str, DataFrame]:
    """The best norm of each context at the three levels, from one count over tokens."""
    tri = counts(tokens)
    return {level: best(tri if level == "tri" else roll_up(tri, level), level) for level in LEVELS}


def look_up(tokens: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Tokens with ``<level>_norm, <level>_total, <level>_conf``; null where a context is unknown."""
    for level, keys in LEVELS.items():
        named = found[level].select(*keys, *[F.col(c).alias(f"{level}_{c}") for c in ("norm", "total", "conf")])
        tokens = tokens.join(named, keys, "left")
    return tokens


def source(variant: Column | str, conf_min: Column | float, protect: Column | bool) -> Column:
    """The level that decides: protected, tri, biL, biR or none. A confident trigram ends the search even if it changes nothing."""
    v = F.lit(variant) if isinstance(variant, str) else variant
    least = F.lit(conf_min) if isinstance(conf_min, float) else conf_min
    guarded = F.lit(protect) if isinstance(protect, bool) else protect
    ok = lambda level: F.coalesce(F.col(f"{level}_conf") >= least, F.lit(False))
    left = ok("biL") & v.isin("tri_biL", "tri_bi_both")
    right = ok("biR") & v.isin("tri_biR", "tri_bi_both")
    return (
        F.when(guarded & F.col("protected"), "protected")
        .when(ok("tri"), "tri")
        .when(left & right, F.when(F.col("biL_total") >= F.col("biR_total"), "biL").otherwise("biR"))
        .when(left, "biL")
        .when(right, "biR")
        .otherwise("none")
    )


def with_protection(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("protected", strong_protect(F.col("raw")))


def chosen(by: Column) -> Column:
    return F.when(by == "tri", F.col("tri_norm")).when(by == "biL", F.col("biL_norm")).when(by == "biR", F.col("biR_norm")).otherwise(F.col("raw"))


def predict(tokens: DataFrame, found: dict[str, DataFrame], config: Config = Config()) -> DataFrame:
    """Tokens with ``source`` and ``tri_pred``."""
    return decide(look_up(tokens, found), config)


def decide(joined: DataFrame, config: Config = Config()) -> DataFrame:
    """``predict`` for tokens that have the levels' columns already, and perhaps ``protected``."""
    if config.variant not in VARIANTS:
        raise ValueError(f"no such variant: {config.variant}")
    guarded = joined if "protected" in joined.columns else with_protection(joined)
    return guarded.withColumn("source", source(config.variant, config.conf_min, config.protect)).withColumn("tri_pred", chosen(F.col("source")))
