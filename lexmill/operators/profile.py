"""Dataset statistics, vocabulary coverage, dictionary classes and change patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mean_of_rounded, ratio, safe_div
from .tokens import explode


def _count(rule: Column) -> Column:
    return F.sum(F.when(rule, 1).otherwise(0)).cast("bigint")


def by_language(sentences: DataFrame) -> DataFrame:
    """Sizes and shares of each language's sentences ``row_id, lang, raw, norm``, whose arrays are aligned.

    Sentences without tokens count as sentences; a language that has no others
    has no tokens and a share of 0.
    """
    sized = sentences.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("num_samples"), F.max(F.size("raw")).cast("bigint").alias("max_sentence_len"))
    changed = F.col("raw") != F.col("norm")
    counted = explode(sentences).groupBy("lang").agg(
        F.count("*").alias("total_tokens"),
        _count(changed).alias("changed_tokens"),
        F.count_distinct("raw").alias("raw_vocab_size"),
        F.count_distinct("norm").alias("norm_vocab_size"),
        _count(F.col("norm") == "").alias("empty_norm_tokens"),
        _count(changed & F.col("norm").contains(" ")).alias("norm_contains_space_tokens"),
        _count(changed & F.col("raw").contains(" ")).alias("raw_contains_space_tokens"),
    )
    both = sized.join(counted, F.col("l").eqNullSafe(F.col("lang")), "left")
    made = both.select(F.col("l").alias("lang"), "num_samples", "max_sentence_len", *[F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns if c != "lang"])
    total = F.col("total_tokens")
    return made.select(
        "*",
        ratio(total, F.col("num_samples")).alias("avg_sentence_len"),
        ratio(F.col("changed_tokens"), total).alias("changed_ratio"),
        F.round(1 - safe_div(F.col("changed_tokens"), total), 6).alias("lai_accuracy"),
        ratio(F.col("empty_norm_tokens"), total).alias("empty_norm_ratio"),
        ratio(F.col("norm_contains_space_tokens"), total).alias("norm_contains_space_ratio"),
    )


def coverage(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Unknown tokens and what the dictionary gets right, by language; ``dictionary`` holds every raw form of the training tokens."""
    size = dictionary.groupBy("lang").agg(F.count("*").alias("train_raw_vocab_size"))
    joined = tokens.join(dictionary.select("lang", "raw", "top_norm"), ["lang", "raw"], "left")
    seen, changed = F.col("top_norm").isNotNull(), F.col("raw") != F.col("norm")
    right = F.coalesce("top_norm", "raw") == F.col("norm")
    made = joined.groupBy("lang").agg(
        F.count("*").alias("total_tokens"),
        _count(changed).alias("changed_tokens"),
        _count(~seen).alias("raw_oov_tokens"),
        _count(changed & ~seen).alias("changed_raw_oov_tokens"),
        _count(seen).alias("mfr_seen_tokens"),
        _count(right).alias("mfr_correct_tokens"),
        _count(changed & seen).alias("mfr_changed_seen_tokens"),
        _count(changed & right).alias("mfr_changed_correct_tokens"),
    )
    total, some = F.col("total_tokens"), F.greatest(F.lit(1), F.col("changed_tokens"))
    return made.join(size, "lang", "left").select(
        *made.columns,
        F.coalesce("train_raw_vocab_size", F.lit(0)).alias("train_raw_vocab_size"),
        ratio(F.col("raw_oov_tokens"), total).alias("raw_oov_ratio"),
        ratio(F.col("changed_raw_oov_tokens"), some).alias("changed_raw_oov_ratio"),
        ratio(F.col("mfr_seen_tokens"), total).alias("mfr_seen_ratio"),
        ratio(F.col("mfr_correct_tokens"), total).alias("mfr_token_accuracy"),
        ratio(F.col("mfr_changed_seen_tokens"), some).alias("mfr_changed_seen_ratio"),
        ratio(F.col("mfr_changed_correct_tokens"), some).alias("mfr_changed_correct_ratio"),
    )


def overall(by_lang: DataFrame) -> DataFrame:
    """One row over languages: sums, and means of the languages' rounded values."""
    total = lambda c: F.sum(c).alias(c)
    made = by_lang.agg(
        F.count("*").alias("num_languages"), total("num_samples"), total("total_tokens"), total("changed_tokens"),
        total("empty_norm_tokens"), total("norm_contains_space_tokens"), F.max("max_sentence_len").alias("max_sentence_len"),
        F.sum(F.col("avg_sentence_len") * F.col("num_samples")).alias("w"),
        mean_of_rounded(F.col("changed_ratio")).alias("macro_changed_ratio"), mean_of_rounded(F.col("lai_accuracy")).alias("macro_lai_accuracy"),
    )
    all_tokens = F.col("total_tokens")
    return made.select(
        *[c for c in made.columns if c != "w"],
        F.round(safe_div(F.col("w"), F.col("num_samples")), 6).alias("avg_sentence_len"),
        ratio(F.col("changed_tokens"), all_tokens).alias("changed_ratio"),
        F.round(1 - safe_div(F.col("changed_tokens"), all_tokens), 6).alias("lai_accuracy"),
        ratio(F.col("empty_norm_tokens"), all_tokens).alias("empty_norm_ratio"),
        ratio(F.col("norm_contains_space_tokens"), all_tokens).alias("norm_contains_space_ratio"),
    )


#: Pattern labels of a changed pair, first that fits (the rules are this library's; the labels are fixed values).
def pattern(raw: str = "raw", norm: str = "norm") -> Column:
    r, n = F.col(raw), F.col(norm)
    plain = lambda c: F.translate(F.lower(c), "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    bare = lambda c: F.regexp_replace(c, r"[.,;:!?\-]", "")
    return (
        F.when(n == "", "empty_norm_alignment")
        .when(F.lower(r) == F.lower(n), "case_change")
        .when(F.regexp_replace(r, r"\s", "") == F.regexp_replace(n, r"\s", ""), "whitespace_change")
        .when(plain(r) == plain(n), "accent_or_diacritic_restore")
        .when(F.translate(r, "'’", "") == F.translate(n, "'’", ""), "apostrophe_or_contraction_change")
        .when(bare(r) == bare(n), "punctuation_change")
        .when(r.rlike("[0-9]"), "digit_related_change")
        .when(F.length(n) > F.length(r) + 2, "expansion_or_abbreviation_restore")
        .when(F.length(n) < F.length(r), "shortening_or_deletion")
        .otherwise("other_substitution")
    )


def changed_pairs(tokens: DataFrame) -> DataFrame:
    """Each changed pair with its counts and shares."""
    made = tokens.groupBy("lang", "raw", "norm").agg(F.count("*").alias("count"))
    w = Window.partitionBy("lang", "raw")
    changed = F.col("raw") != F.col("norm")
    sized = made.withColumn("raw_total", F.sum("count").over(w)).withColumn("changed_total", F.sum(F.when(changed, F.col("count")).otherwise(0)).over(w))
    return sized.where(changed).select(
        "lang", "raw", "norm", "count", "raw_total", "changed_total",
        ratio(F.col("count"), F.col("changed_total")).alias("changed_confidence"),
        ratio(F.col("count"), F.col("raw_total")).alias("raw_confidence"),
    )


def top_pairs(tokens: DataFrame, n: int = 300) -> DataFrame:
    """The ``n`` most frequent changed pairs of each language, with their pattern."""
    w = Window.partitionBy("lang").orderBy(F.col("count").desc(), "raw", "norm")
    ranked = changed_pairs(tokens).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.withColumn("pattern", pattern()).drop("changed_total")


#: Least counts and shares of the dictionary's classes (fixed values).
HIGH, BALANCED = (2, 0.85, 0.50), (1, 0.75, 0.30)


def classes(tokens: DataFrame) -> DataFrame:
    """``lang, raw, norm, ..., n_norms, high, balanced, class``: each raw form's most frequent change, classed by thresholds."""
    w = Window.partitionBy("lang", "raw").orderBy(F.col("count").desc(), "norm")
    pairs = changed_pairs(tokens)
    sized = pairs.withColumn("n_norms", F.count("*").over(Window.partitionBy("lang", "raw"))).withColumn("k", F.row_number().over(w))
    fits = lambda t: (F.col("count") >= t[0]) & (F.col("changed_confidence") >= t[1]) & (F.col("raw_confidence") >= t[2])
    kind = F.when(fits(HIGH), "high").when(fits(BALANCED), "balanced").when(F.col("n_norms") > 1, "ambiguous").otherwise("review")
    return sized.where("k = 1").select(*pairs.columns, "n_norms", fits(HIGH).alias("high"), fits(BALANCED).alias("balanced"), kind.alias("class"))


def apply_dictionary(tokens: DataFrame, entries: DataFrame, protected: Column, keep_context: bool = False) -> DataFrame:
    """``pred`` by dictionary: protected tokens stay; context-sensitive ones stay too unless they have a pair (always with ``keep_context``)."""
    joined = tokens.join(entries, ["lang", "raw"], "left")
    sensitive = F.coalesce(F.col("context_sensitive"), F.lit(False))
    use = F.col("pair_norm").isNotNull() & ~protected
    if keep_context:
        use = use & ~sensitive
    return joined.withColumn("pred", F.when(use, F.col("pair_norm")).otherwise(F.col("raw")))
