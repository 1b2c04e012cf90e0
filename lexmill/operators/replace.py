"""Most-frequent-replacement statistics, look-ups and guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import JA_PUNCT, lang_code, rx, strong_protect


def pair_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("lang", "raw", "norm").agg(F.count("*").alias("c"))


def dictionary(tokens: DataFrame) -> DataFrame:
    """``lang, raw, top_norm, top_count, total``: the most frequent norm; ties go to the one that sorts first."""
    best = F.min(F.struct((-F.col("c")).alias("n"), "norm")).alias("m")
    return pair_counts(tokens).groupBy("lang", "raw").agg(best, F.sum("c").alias("total")).select(
        "lang", "raw", F.col("m.norm").alias("top_norm"), (-F.col("m.n")).alias("top_count"), "total"
    )


def statistics(tokens: DataFrame) -> DataFrame:
    """The dictionary with ``confidence, change_rate, margin, entropy`` and all candidates by falling count."""
    grouped = pair_counts(tokens).groupBy("lang", "raw").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("n"), "norm"))).alias("all"), F.sum("c").alias("total")
    )
    made = measures()
    return grouped.select("lang", "raw", *[made[c].alias(c) if c in made else c for c in ("top_norm", "top_count", "total", "confidence", "change_rate", "margin", "entropy", "candidates")])


def measures() -> dict[str, Column]:
    """The statistics of a form, by name, from ``raw``, ``total`` and ``all``: its norms in order, each with its count below zero."""
    total = F.col("total").cast("double")
    count = lambda k: F.coalesce(-F.get("all", F.lit(k)).n, F.lit(0))
    share = lambda x: -x.n / total
    raw_count = F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x.norm == F.col("raw"), -x.n).otherwise(0))
    return {
        "top_norm": F.get("all", F.lit(0)).norm,
        "top_count": count(0),
        "confidence": count(0) / total,
        "change_rate": (F.col("total") - raw_count) / total,
        "margin": (count(0) - count(1)) / total,
        "entropy": -F.aggregate("all", F.lit(0.0), lambda a, x: a + share(x) * F.log(share(x))),
        "candidates": F.transform("all", lambda x: F.struct(x.norm.alias("norm"), (-x.n).alias("count"))),
    }


def look_up(tokens: DataFrame, stats: DataFrame, *columns: str) -> DataFrame:
    """Tokens with the statistics' columns of their language and raw form; null where there is none."""
    return tokens.join(stats.select("lang", "raw", *columns), ["lang", "raw"], "left")


def predict(tokens: DataFrame, stats: DataFrame) -> DataFrame:
    return look_up(tokens, stats, "top_norm").withColumn("pred", F.coalesce("top_norm", "raw"))


#: First guard: mode and thresholds of each language (fixed values); others use ``base``.
GUARD_ONE = {
    "vi": ("margin_guard", {"margin": 0.20}), "iden": ("confidence_guard", {"confidence": 0.80}), "en": ("margin_guard", {"margin": 0.20}),
    "id": ("change_guard", {"change_rate": 0.75}), "sl": ("margin_guard", {"margin": 0.20}), "sr": ("change_guard", {"change_rate": 0.75}),
    "th": ("margin_guard", {"margin": 0.20}), "hr": ("base", {}), "nl": ("change_guard", {"change_rate": 0.75}),
    "de": ("change_guard", {"change_rate": 0.75}), "ja": ("margin_guard", {"margin": 0.20}), "ko": ("change_guard", {"change_rate": 0.75}),
}


def guard_one_rule(mode: str, values: dict[str, float] | None = None) -> Column:
    """If an entry is applied under a mode; entries that are missing never are."""
    v = values or {}
    have = F.col("top_norm").isNotNull()
    counted = F.coalesce(F.col("total"), F.lit(0)) >= v.get("min_count", 1)
    score = lambda name, least: F.coalesce(F.col(name), F.lit(0.0)) >= v.get(name, least)
    calm = lambda most: F.coalesce(F.col("entropy"), F.lit(float("inf"))) <= v.get("entropy", most)
    rules = {
        "base": F.lit(True),
        "change_guard": counted & score("change_rate", 0.75),
        "confidence_guard": counted & score("confidence", 0.80),
        "margin_guard": counted & score("margin", 0.20),
        "entropy_guard": counted & calm(0.50),
        "combined_guard": counted & score("confidence", 0.0) & score("change_rate", 0.0) & score("margin", 0.0) & calm(float("inf")),
    }
    if mode not in rules:
        raise ValueError(f"no such guard: {mode}")
    return have & rules[mode]


def guard_one(tokens: DataFrame, stats: DataFrame, config: dict = GUARD_ONE) -> DataFrame:
    """Tokens with ``pred`` and ``applied`` under each language's guard."""
    found = look_up(tokens, stats, "top_norm", "total", "confidence", "change_rate", "margin", "entropy")
    code, use = lang_code(F.col("lang")), guard_one_rule("base")
    for lang, (mode, values) in config.items():
        use = F.when(code == lang, guard_one_rule(mode, values)).otherwise(use)
    return found.withColumn("applied", use).withColumn("pred", F.when(F.col("applied"), F.col("top_norm")).otherwise(F.col("raw")))


@dataclass(frozen=True)
class GuardTwo:
    """Thresholds of the second guard."""

    protected: float = 0.8
    normal: float = 0.0
    ja_punct: float = 0.95
    digit_suffix: float = 0.5
    time: float = 0.5


def guard_two_rule(config: GuardTwo = GuardTwo(), protected: Column | None = None) -> Column:
    """If an entry is applied: protected tokens (a column, or tested here) go through ordered exceptions, the first that fits decides."""
    code, tok, norm, conf = lang_code(F.col("lang")), F.col("raw"), F.col("top_norm"), F.col("confidence")
    exceptions = (
        F.when(tok.startswith("@") & (norm == "[mention]"), True)
        .when(code.isin("id", "iden") & tok.rlike(r"[A-Za-zÀ-ÿ]+2(?:[A-Za-zÀ-ÿ]+)?$"), True)
        .when(code.isin("hr", "sl", "sr") & tok.rlike(rx(r"\d")) & tok.rlike("[A-Za-zÀ-ÿ]"), conf >= config.digit_suffix)
        .when(tok.rlike(rx(r"^\d{3,4}\z")) & norm.rlike("[.:]"), conf >= config.time)
        .when((code == "ja") & tok.isin(JA_PUNCT), conf >= config.ja_punct)
        .otherwise(conf >= config.protected)
    )
    return F.when(norm.isNull(), False).when(strong_protect(tok) if protected is None else protected, exceptions).otherwise(conf >= config.normal)


def guard_two(tokens: DataFrame, stats: DataFrame, config: GuardTwo = GuardTwo(), *extra: str) -> DataFrame:
    """Tokens with ``pred`` and ``applied``, and the extra columns of the statistics."""
    return apply_two(look_up(tokens, stats, "top_norm", "confidence", *extra), config)


def apply_two(found: DataFrame, config: GuardTwo = GuardTwo()) -> DataFrame:
    """``guard_two`` for tokens that have the statistics' columns already, and perhaps ``protected``."""
    return found.withColumn("applied", guard_two_rule(config, F.col("protected") if "protected" in found.columns else None)).withColumn("pred", F.when(F.col("applied"), F.col("top_norm")).otherwise(F.col("raw")))


def top_candidates(n: int = 5) -> Column:
    """The first candidates, as ``norm:count`` joined by commas."""
    return F.array_join(F.transform(F.slice("candidates", 1, n), lambda x: F.concat_ws(":", x.norm, x["count"])), ",")


def category() -> Column:
    """Why a hard case has no replacement: no entry, only itself, or others too."""
    other = F.exists("candidates", lambda x: x.norm != F.col("raw"))
    return F.when(F.col("candidates").isNull(), "mfr_oov").when(other, "has_non_raw_cands").otherwise("all_cands_raw")
