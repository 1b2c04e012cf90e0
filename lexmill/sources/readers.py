"""Readers of sentences, predictions, dictionaries and correction logs, all through Spark's own readers."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_KEYS = ["pred", "prediction", "predictions", "norm", "normalized"]
TOKENS = "array<string>"


class SchemaError(ValueError):
    """A table or file without the columns or shape that is asked for."""


def sentences(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Sentences ``raw, norm, lang`` (other columns stay) from Parquet or JSON, by the path's ending."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif name.endswith((".jsonl", ".json")):
        df = spark.read.json(path, multiLine=name.endswith(".json"))
    else:
        raise SchemaError(f"no reader for {path}")
    missing = {"raw", "norm", "lang"} - set(df.columns)
    if missing:
        raise SchemaError(f"{path} lacks {', '.join(sorted(missing))}")
    return df.where(F.col("split") == split) if split and "split" in df.columns else df


def invalid(df: DataFrame) -> DataFrame:
    """Sentences whose arrays are null, hold nulls or differ in length."""
    bad = lambda c: F.col(c).isNull() | F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
    return df.where(bad("raw") | bad("norm") | (F.size("raw") != F.size("norm")) | F.col("lang").isNull())


def has_gold(df: DataFrame) -> Column:
    """An aggregate: if any norm isn't empty."""
    return F.coalesce(F.bool_or(F.exists("norm", lambda x: x != "")), F.lit(False)).alias("has_gold")


def parse_tokens(c: Column) -> Column:
    """Tokens of a text that holds a JSON list, a Python list of strings, or words between white space."""
    listed = F.from_json(c, TOKENS, {"allowSingleQuotes": "true"})
    return F.when(F.trim(c).startswith("["), F.coalesce(listed, F.split(F.trim(c), r"\s+"))).otherwise(F.split(F.trim(c), r"\s+"))


#: Objects within objects that are looked into for a prediction field.
LEVELS = 8


def _unwrapped(value: Column) -> Column:
    """A JSON value, or what its first prediction field holds, down to what is no object."""
    held = lambda v: F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in PREDICTION_KEYS])
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), value, lambda v, _: F.when(F.ltrim(v).startswith("{"), held(v)).otherwise(v))


def _keyed(value: Column) -> Column:
    """The tokens of a JSON value: a list, or the first prediction field of an object, however deep."""
    return F.from_json(_unwrapped(value), TOKENS)


def numbered(df: DataFrame) -> DataFrame:
    """Rows with ``row_id``, their place in the order in which they are read.

    Two passes without a shuffle: a count a partition (all that the driver
    sees), then each partition's start added to the place within it.
    """
    at = df.withColumn("_at", F.monotonically_increasing_id())
    sizes = at.groupBy(F.shiftright("_at", 33).cast("int").alias("part")).count().collect()
    parts = sorted((r["part"], r["count"]) for r in sizes)
    starts = [0, *accumulate(n for _, n in parts)]
    known = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(parts, starts, strict=False)], "_part int, _start bigint")
    placed = at.withColumn("_part", F.shiftright("_at", 33).cast("int")).join(F.broadcast(known), "_part")
    return placed.select((F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("row_id"), *[F.col(f"`{c}`") for c in df.columns])


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, pred`` in the file's order, from JSON, JSONL, TSV, TXT or CSV."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        text = spark.read.text(path, wholetext=True).select("value")
        items = text.select(F.posexplode(F.from_json(_unwrapped(F.col("value")), "array<string>")).alias("row_id", "item"))
        return items.select("row_id", _keyed(F.col("item")).alias("pred"))
    if kind == "jsonl":
        lines = spark.read.text(path).where("trim(value) <> ''")
        return numbered(lines).select("row_id", _keyed(F.col("value")).alias("pred"))
    if kind in ("tsv", "txt"):
        lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("pred"))
        quoted = F.transform("pred", lambda x: F.when(x.rlike('^".*"$'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
        return numbered(lines.select(quoted.alias("pred")))
    if kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
        column = next((k for k in PREDICTION_KEYS if k in df.columns), None)
        if not column:
            raise SchemaError(f"{path} has none of {PREDICTION_KEYS}")
        return numbered(df).select("row_id", F.from_json(column, TOKENS).alias("pred"))
    raise SchemaError(f"no reader for {path}")


ENTRY = "map<string,struct<top_norm:string,top_count:bigint,raw_total:bigint,changed_total:bigint,changed_confidence:double,raw_confidence:double,candidates:map<string,bigint>>>"
SECTIONS = {"high": "high_confidence_pairs", "balanced": "balanced_pairs_for_analysis", "review": "review_pairs", "ambiguous": "ambiguous_pairs", "context": "context_sensitive_pairs", "seed": "paper_seed_pairs"}


def dictionary(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """``lang, section, raw, norm, count, raw_total, context_sensitive, flagged`` from a dictionary file.

    ``flagged`` tells if the entry itself says that it depends on context.

    A section's entries map a raw form to its norm, or to an object with its
    evidence; lists of objects and objects per language are read as well.
    """
    text = spark.read.text(path, wholetext=True).select(F.coalesce(F.lit(lang), F.get_json_object("value", "$.language"), F.lit("")).alias("lang"), "value")
    sensitive = F.coalesce(F.from_json(F.get_json_object("value", "$.context_sensitive_tokens"), TOKENS), F.expr("cast(array() as array<string>)"))
    base = text.select("lang", "value", sensitive.alias("cs"))
    parts = []
    for section, key in SECTIONS.items():
        held = F.from_json(F.get_json_object("value", f"$.{key}"), "map<string,string>")
        rows = base.select("lang", "cs", F.explode(held).alias("raw", "v"))
        field = lambda *names: F.coalesce(*[F.get_json_object("v", f"$.{n}") for n in names])
        plain = ~F.col("v").startswith("{")
        parts.append(
            rows.select(
                "lang", F.lit(section).alias("section"), "raw", F.when(plain, F.col("v")).otherwise(field("norm", "normalized", "top_norm")).alias("norm"),
                F.when(~plain, field("top_count", "count")).cast("bigint").alias("count"), F.when(~plain, field("raw_total")).cast("bigint").alias("raw_total"),
                (F.array_contains("cs", F.col("raw")) | F.lit(section == "ambiguous")).alias("context_sensitive"),
                F.coalesce(~plain & (field("context_sensitive", "ambiguous", "is_context_sensitive") == "true"), F.lit(False)).alias("flagged"),
            )
        )
    listed = F.from_json("value", "array<struct<raw:string,norm:string,count:bigint,context_sensitive:boolean>>")
    rows = base.where("ltrim(value) like '[%'").select("lang", F.explode(listed).alias("e"))
    parts.append(
        rows.select("lang", F.lit("high").alias("section"), "e.raw", "e.norm", "e.count", F.lit(None).cast("bigint").alias("raw_total"), F.coalesce("e.context_sensitive", F.lit(False)).alias("context_sensitive"), F.coalesce("e.context_sensitive", F.lit(False)).alias("flagged"))
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CORRECTIONS = "dev_row_idx bigint, tok_idx int, lang string, token string, gt string, cat string, raw_response string, normalized string, error string"


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """A correction log ``row_id, tok_idx, token, normalized, error, seq`` in its order."""
    log = spark.read.schema(CORRECTIONS).json(path)
    return log.select(F.col("dev_row_idx").alias("row_id"), "tok_idx", "token", "normalized", "error", F.monotonically_increasing_id().alias("seq"))


def statistics(spark: SparkSession, path: str, langs: list[str] | None = None) -> DataFrame:
    """Statistics as ``writers.statistics`` stores them; only the folders of ``langs`` are read if they are given."""
    df = spark.read.parquet(path)
    df = df.select(F.col("lang").cast("string").alias("lang"), *[c for c in df.columns if c != "lang"])
    return df if langs is None else df.where(F.col("lang").isin(langs))
