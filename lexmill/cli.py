"""Commands: ``python -m lexmill <command>``. Each builds a plan from the operators and writes its result."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import cascade, evaluate, model, ngram, profile, prompts, replace, tokens
from .sources import readers, writers

TOKEN = "row_id bigint, tok_idx int, lang string, token string"


def _load(name: str) -> Callable:
    """A factory by ``module:name``; executors import the module, so it must be installed or shipped there."""
    module, _, attribute = name.partition(":")
    return lambda: getattr(importlib.import_module(module), attribute)()


def _sentences(spark: SparkSession, path: str) -> DataFrame:
    return readers.numbered(readers.sentences(spark, path).select("raw", "norm", "lang"))


def _train_tokens(spark: SparkSession, path: str) -> DataFrame:
    return tokens.explode(tokens.align(_sentences(spark, path), "skip"))


def _input_tokens(sentences: DataFrame) -> DataFrame:
    """Token rows; a missing norm is the raw token, so sentences without gold can be mined."""
    return tokens.explode(tokens.align(sentences, "pad"))


def _views(official: str | None, missing: str | None) -> dict[str, list[str]]:
    given = {"official12": official, "missing5": missing}
    return {name: given[name].split(",") if given[name] else langs for name, langs in evaluate.VIEWS.items()}


def stats(spark: SparkSession, a) -> None:
    """Profiles of a data set, by language and over all; with training data, its dictionary's coverage."""
    sentences = _sentences(spark, a.gold).where("size(raw) = size(norm)")
    rows, by_lang = tokens.explode(sentences), profile.by_language(sentences)
    named = lambda df: df.select(F.lit(a.dataset_name).alias("dataset_name"), *df.columns)
    writers.metrics_csv([named(by_lang)], f"{a.out}/languages")
    writers.metrics_json(named(profile.overall(by_lang)), f"{a.out}/overall")
    if a.train:
        writers.metrics_csv([named(profile.coverage(rows, replace.dictionary(_train_tokens(spark, a.train))))], f"{a.out}/coverage")


def _measured(spark: SparkSession, a) -> DataFrame:
    sentences = tokens.align(_sentences(spark, a.gold), "skip")
    if a.pred:
        scored = evaluate.scored_rows(sentences, readers.predictions(spark, a.pred))
    elif a.baseline == "mfr":
        if not a.train:
            raise SystemExit("the replacement baseline needs --train")
        scored = replace.predict(tokens.explode(sentences), replace.dictionary(_train_tokens(spark, a.train)))
    else:
        scored = evaluate.unchanged(tokens.explode(sentences))
    every = evaluate.with_views(scored.select("lang", "raw", "norm", "pred"), _views(a.official_langs, a.missing_langs))
    wanted = every if "all_views" in a.eval_groups else every.where(F.col("eval_group").isin(a.eval_groups))
    return evaluate.by_language(wanted, "eval_group")


def evaluate_command(spark: SparkSession, a) -> None:
    """Metrics of predictions or of a baseline, by view and language and over all."""
    measured = _measured(spark, a)
    name = a.model_name or a.baseline
    writers.metrics_csv([evaluate.language_rows(measured, a.dataset_name, name)], f"{a.out}/languages")
    writers.metrics_json(evaluate.overall_rows(measured, a.dataset_name, name, a.notes, "eval_group"), f"{a.out}/overall")


def score(spark: SparkSession, a) -> None:
    """Metrics of predictions as a table on the screen."""
    scored = evaluate.scored_rows(tokens.align(_sentences(spark, a.gold), "pad"), readers.predictions(spark, a.pred))
    print(a.name or a.pred)
    print(evaluate.as_table(evaluate.by_language(scored)))


def _predicted(spark: SparkSession, a, rows: DataFrame) -> DataFrame:
    """Tokens with ``base_pred`` by the predictors that are switched on."""
    train = _train_tokens(spark, a.train)
    first, second = ("mfr_pred", "tri_pred") if a.mfr_first else ("tri_pred", "mfr_pred")
    used = [c for c in (first, second) if not (c == "tri_pred" and a.no_trigram) and not (c == "mfr_pred" and a.no_mfr)]
    made = ngram.predict(rows, ngram.tables(train)) if "tri_pred" in used else rows
    found = replace.guard_two(made, replace.statistics(train), replace.GuardTwo(), "candidates").withColumnRenamed("pred", "mfr_pred")
    return found.withColumn("base_pred", cascade.cascade(*used, *[None] * (2 - len(used))) if used else F.col("raw"))


def mine(spark: SparkSession, a) -> None:
    """Base predictions, and the hard cases that they leave: noisy, not protected, unchanged."""
    sentences = _sentences(spark, a.input)
    scores = model.noise_scores(sentences, _load(a.scorer))
    rows = _predicted(spark, a, _input_tokens(sentences)).join(scores, ["row_id", "tok_idx"], "left")
    made = rows.withColumn("noisy", F.coalesce(cascade.thresholds(F.col("p"), a.threshold), F.lit(False)))
    kept = made.select(
        "row_id", "tok_idx", "lang", "raw", "norm", "prev", "next", "base_pred", replace.category().alias("cat"),
        F.coalesce(replace.top_candidates(), F.lit("")).alias("mfr_top5"), cascade.is_hard().alias("hard"),
    )
    kept.write.mode("overwrite").parquet(f"{a.work}/base")
    base = spark.read.parquet(f"{a.work}/base")
    hard = base.where("hard").select("row_id", "tok_idx", "lang", F.col("raw").alias("token"), "prev", "next", F.col("norm").alias("gt"), "cat", "mfr_top5")
    hard.write.mode("overwrite").json(f"{a.work}/hard")
    writers.predictions(_rebuilt(sentences, base.withColumn("pred", F.col("base_pred"))), f"{a.work}/predictions")


def _rebuilt(sentences: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every sentence with ``pred``; one without tokens keeps its own."""
    made = tokens.reassemble(predicted, "pred").select("row_id", "pred")
    return sentences.join(made, "row_id", "left").withColumn("pred", F.coalesce("pred", "raw"))


def correct(spark: SparkSession, a) -> None:
    """Ask a client about the hard cases that the log doesn't hold yet, and add its answers to the log."""
    hard = spark.read.schema(f"{TOKEN}, cat string").json(f"{a.work}/hard")
    todo = cascade.todo(hard, readers.corrections(spark, a.log)) if a.resume else hard
    asked = prompts.with_prompt(todo, _sentences(spark, a.input))
    answers = model.correct(asked, _load(a.client), a.workers, a.retries)
    # Held in a table first: the log is read and written in one run, and answers cost calls.
    answers.write.mode("overwrite").parquet(f"{a.work}/answers")
    writers.append_log(spark.read.parquet(f"{a.work}/answers").withColumnRenamed("row_id", "dev_row_idx"), a.log)


def build(spark: SparkSession, a) -> None:
    """A submission from base predictions with the log's corrections laid over hard cases."""
    base = spark.read.parquet(f"{a.work}/base")
    if a.no_llm:
        final = base.withColumn("pred", F.col("base_pred"))
    else:
        log = readers.corrections(spark, a.log).join(base.where("hard").select("row_id", "tok_idx"), ["row_id", "tok_idx"], "left_semi")
        final = cascade.overlay(base, log)
    n = writers.submission_zip(_rebuilt(_sentences(spark, a.input), final), a.submission)
    print(f"{n} sentences in {a.submission}")


def ablation(spark: SparkSession, a) -> None:
    """Metrics of each n-gram variant and least confidence, alone or before the replacement dictionary."""
    train, rows = _train_tokens(spark, a.train), tokens.explode(tokens.align(_sentences(spark, a.input), "skip"))
    joined = ngram.look_up(ngram.with_protection(rows), ngram.tables(train))
    if a.mode == "full":
        joined = replace.guard_two(joined, replace.statistics(train)).withColumnRenamed("pred", "after").drop("applied", "top_norm", "confidence")
    else:
        joined = joined.withColumn("after", F.col("raw"))
    grid = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(round(0.5 + 0.05 * k, 2)).alias("conf_min")) for v in ngram.VARIANTS for k in range(11)])
    # Tokens alike in all that the grid looks at are one kind: the grid multiplies kinds.
    alike = ["lang", "raw", "norm", "after", "protected", *[f"{n}_{c}" for n in ngram.LEVELS for c in ("norm", "total", "conf")]]
    every = joined.groupBy(*alike).agg(F.count("*").alias("w")).withColumn("g", F.explode(grid)).select("*", "g.variant", "g.conf_min")
    told = every.withColumn("told", ngram.chosen(ngram.source(F.col("variant"), F.col("conf_min"), False)))
    scored = told.withColumn("pred", F.coalesce(F.nullif("told", "raw"), F.nullif("after", "raw"), F.col("raw")))
    counted = scored.groupBy("variant", "conf_min").agg(*evaluate.confusion(F.col("w")))
    writers.metrics_csv([counted.select("variant", "conf_min", *evaluate.COUNTS, *evaluate.metrics()).orderBy("variant", "conf_min")], a.output)


def parser(settings: Settings) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, /, **options):
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for key, how in options.items():
            p.add_argument(*dict.fromkeys((f"--{key}", f"--{key.replace('_', '-')}")), dest=key, **how)

    switch, needed = {"action": "store_true"}, {"required": True}
    given = lambda name: {"default": getattr(settings, name)}
    command("stats", stats, gold=needed, train={}, dataset_name={"default": "dataset"}, out=needed)
    command(
        "evaluate", evaluate_command, gold=needed, pred={}, baseline={"choices": ["lai", "mfr"], "default": "lai"}, train={}, dataset_name={"default": "dataset"},
        model_name={}, notes={"default": ""}, out=needed, eval_groups={"nargs": "+", "choices": ["all", *evaluate.VIEWS, "all_views"], "default": ["all_views"]},
        official_langs={}, missing_langs={},
    )
    command("score", score, pred=needed, gold=needed, name={"default": ""})
    command(
        "mine", mine, train=given("train"), input=given("input"), work=given("work"), threshold={"type": float, "default": settings.threshold},
        scorer={"default": "lexmill.operators.model:fixed_scorer"}, no_trigram=switch, no_mfr=switch, mfr_first=switch,
    )
    command("correct", correct, client=needed, input=given("input"), work=given("work"), log=given("log"), workers={"type": int, "default": 2}, retries={"type": int, "default": 3}, resume=switch)
    command("build", build, input=given("input"), work=given("work"), log=given("log"), submission=given("submission"), no_llm=switch)
    command("ablation", ablation, train=given("train"), input=given("input"), mode={"choices": ["tri_only", "full"], "default": "tri_only"}, output=needed)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser(Settings.load()).parse_args(argv)
    a.run(spark or SparkSession.builder.appName("lexmill").getOrCreate(), a)
