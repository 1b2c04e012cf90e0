"""Predictions of a large corpus, looked up only where a context can change a token.

A level changes a token only where at least half of its context's training
tokens have another norm than the raw form; call such a context telling. The
same holds for the raw form alone and its most frequent replacement. A token
without any telling context or form stays as it is at every threshold of
``LEAST`` and more, so only the others are looked up, by exact counts.

Bloom filters say which tokens belong to a set of contexts. They let some more
through and never fewer, so they decide what is shuffled and not what comes out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import interim
from . import ngram
from .tokens import position

#: Keys of the sets: contexts of each level, the form alone, and the token itself.
KEYS = ngram.LEVELS | {"form": ["lang", "raw"], "token": ["row_id", "tok_idx"]}
#: No threshold under this one: a norm of a smaller share is never taken.
LEAST = 0.5
#: Bits of a filter: one to eight for each byte of the input's files, within bounds.
FEWEST, MOST = 1 << 16, 1 << 27
_LIMITS = {"spark.sql.optimizer.runtime.bloomFilter.maxNumBits": MOST, "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": MOST // 8}
#: Tasks that build a filter; each sends one of full size, so few.
BUILDERS = 2
#: Parts of the forms in which tokens are looked up, one after the other.
PARTS = 4


@dataclass(frozen=True)
class Contexts:
    """Sets of contexts by level, as filters in one row that was written."""

    filters: DataFrame

    def hold(self, level: str) -> Column:
        """If the set may hold a token's context; those of no language are in none. The set of tokens has any language."""
        jvm = self.filters.sparkSession._jvm
        ex = jvm.org.apache.spark.sql.classic.ExpressionUtils
        asked = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
            ex.expression(self.filters.select(level).scalar()._jc), ex.expression(F.xxhash64(*KEYS[level])._jc)
        )
        held = F.coalesce(Column(ex.column(asked)), F.lit(False))
        return held if level == "token" else F.col("lang").isNotNull() & held

    def any(self) -> Column:
        out = F.lit(False)
        for level in self.filters.columns:
            out = out | self.hold(level)
        return out


def contexts(spark: SparkSession, hashes: DataFrame, input_bytes: int) -> Contexts:
    """The set of the hashes in each column, named by level; nulls are left out."""
    from pyspark.sql.internal import InternalFunction  # the sketch that DataFrame.stat.bloomFilter is made of

    bits = min(MOST, max(FEWEST, 1 << max(0, input_bytes // 8).bit_length()))
    made = lambda c: InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", F.col(c), F.lit(bits // 8).cast("bigint"), F.lit(bits).cast("bigint")).alias(c)
    before = {k: spark.conf.get(k, None) for k in _LIMITS}
    for k, v in _LIMITS.items():
        spark.conf.set(k, str(v))
    try:
        return Contexts(interim.once(spark, hashes.repartition(BUILDERS).agg(*map(made, hashes.columns))))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def tokens_of(spark: SparkSession, rows: DataFrame, input_bytes: int) -> Contexts:
    """The set of the rows' tokens, by ``row_id`` and ``tok_idx``."""
    return contexts(spark, _hashes(rows, token=F.lit(True)), input_bytes)


def forms_of(spark: SparkSession, rows: DataFrame, input_bytes: int) -> Contexts:
    """The set of the rows' raw forms, by language; each is sent once a task."""
    return contexts(spark, _hashes(rows.select("lang", "raw").distinct(), form=F.lit(True)), input_bytes)


def _hashes(rows: DataFrame, **levels: Column) -> DataFrame:
    """Hashes of the keys by level, where the level's column is true; rows without any are left out."""
    made = rows.select(*[F.when(held, F.xxhash64(*KEYS[level])).alias(level) for level, held in levels.items()])
    return made.where(F.coalesce(*levels).isNotNull())


def _by_level(rows: DataFrame, left: Column, right: Column, form: Column, *columns: str) -> DataFrame:
    """A row for each level of a token whose context is in the sets: ``level``, the keys that the level has, and the columns."""
    # No condition on these columns: it would be moved below them, with a copy of each filter for every task that is sent.
    rows = rows.withColumn("_l", left).withColumn("_r", right).withColumn("_f", form)
    at = {"biL": F.col("_l"), "biR": F.col("_r"), "tri": F.col("_l") & F.col("_r"), "form": F.col("_f")}
    levels = F.array_compact(F.array(*[F.when(held, F.lit(level)) for level, held in at.items()]))
    every = rows.withColumn("level", F.explode(levels))
    prev, next_ = [F.when(F.col("level").isin("tri", level), F.col(c)).alias(c) for level, c in (("biL", "prev"), ("biR", "next"))]
    return every.select("level", "lang", "raw", prev, next_, *columns)


_CONTEXT = ["level", "lang", "raw", "prev", "next"]


def _telling(spark: SparkSession, train: DataFrame, val: DataFrame, input_bytes: int) -> Contexts:
    """The contexts of validation tokens, and the forms, of which at least half of the training tokens are changed."""
    every = F.lit(True)
    changed = contexts(spark, _hashes(train.where("raw <> norm"), biL=every, biR=every, form=every), input_bytes)
    asked = contexts(spark, _hashes(val, biL=changed.hold("biL"), biR=changed.hold("biR")), input_bytes)
    rows = _by_level(train.withColumn("ch", F.col("raw") != F.col("norm")), asked.hold("biL"), asked.hold("biR"), changed.hold("form"), "ch")
    counted = rows.groupBy(*_CONTEXT).agg(F.count("*").alias("n"), F.count_if("ch").alias("c")).where(F.col("c") >= F.col("n") * LEAST)
    return contexts(spark, _hashes(counted, **{level: F.col("level") == level for level in (*ngram.LEVELS, "form")}), input_bytes)


def split(spark: SparkSession, rows: DataFrame, input_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Validation tokens ``row_id, tok_idx, lang, raw, norm, prev, next``: those with a telling context or form, and the others.

    The first have ``<level>_norm, <level>_total, <level>_conf`` as
    ``ngram.look_up`` gives them, and, where the form tells, ``top_norm`` and
    ``confidence`` as ``replace.look_up`` does: elsewhere no replacement
    differs from the raw form. They are written; the others are read from the
    rows again wherever they are used.
    """
    train, val = rows.where(~F.col("val") & F.col("lang").isNotNull()), rows.where("val")
    val = val.select("row_id", "tok_idx", "lang", "raw", "norm", "prev", "next")
    telling = _telling(spark, train, val, input_bytes)
    told, every = interim.once(spark, val.where(telling.any())), F.lit(True)
    asked = contexts(spark, _hashes(told, biL=every, biR=every, form=telling.hold("form")), input_bytes)
    counts = _by_level(train.withColumn("_p", position()), asked.hold("biL"), asked.hold("biR"), asked.hold("form"), "norm", "_p")
    counted = interim.once(spark, counts.groupBy(*_CONTEXT, "norm").agg(F.count("*").alias("c"), F.min("_p").alias("first_pos")))

    def found(k: int) -> DataFrame:
        mine = lambda rows: rows.where(F.pmod(F.xxhash64("lang", "raw"), F.lit(PARTS)) == k)
        part = mine(counted)
        levels = {level: ngram.best(part.where(F.col("level") == level), level) for level in ngram.LEVELS}
        top = F.min(F.struct((-F.col("c")).alias("n"), "norm")).alias("m")
        forms = part.where("level = 'form'").groupBy("lang", "raw").agg(top, F.sum("c").alias("total"))
        forms = forms.select("lang", "raw", F.col("m.norm").alias("top_norm"), (-F.col("m.n") / F.col("total")).alias("confidence"))
        return ngram.look_up(mine(told), levels).join(forms, ["lang", "raw"], "left")

    return interim.in_parts(spark, found, PARTS), val.where(~telling.any())


def with_levels(spark: SparkSession, rows: DataFrame, input_bytes: int) -> DataFrame:
    """Both halves of ``split`` with the levels, which are null for the others."""
    told, rest = split(spark, rows, input_bytes)
    return told.drop("top_norm", "confidence").unionByName(rest, allowMissingColumns=True)
