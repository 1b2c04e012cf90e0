"""Hints and pairs, labels, reports, settings and the commands."""

import json
import zipfile

import pytest

from lexmill import cli, config
from lexmill.operators import evaluate, hints, labels, profile, prompts
from lexmill.sources import readers, writers
from pyspark.sql import functions as F

SENTENCE = "raw array<string>, norm array<string>, lang string"


@pytest.fixture
def entries(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(
        json.dumps(
            {
                "language": "en",
                "high_confidence_pairs": {"u": "you", "r": {"norm": "are", "ambiguous": True}, "RT": "retweet", "ok": "ok"},
                "review_pairs": {"r": {"top_norm": "our", "top_count": 2}},
                "ambiguous_pairs": {"r": {"top_norm": "or"}, "2": "to"},
                "context_sensitive_pairs": {"2": {"norm": "too"}},
            }
        )
    )
    return readers.dictionary(spark, str(path))


def test_pairs_and_hints(spark, entries):
    assert {(r.raw, r.pair_norm) for r in hints.pairs(entries).collect()} == {("u", "you"), ("RT", "retweet"), ("ok", "ok")}
    got = {r.raw: [(h.source, h.norm) for h in r.hints] for r in hints.hints(entries).collect()}
    assert got == {
        "r": [("review_pairs", "our"), ("ambiguous_pairs", "or"), ("high_confidence_context_sensitive", "are")],
        "2": [("ambiguous_pairs", "to"), ("context_sensitive_pairs", "too")],
    }
    assert all(len(r.hints) == 1 for r in hints.hints(entries, 1).collect())


def test_application_and_candidates(spark, entries):
    rows = spark.createDataFrame([(1, k, "en", t) for k, t in enumerate(["u", "RT", "ok", "r", "x"])] + [(2, 0, "de", "u")], "row_id bigint, tok_idx int, lang string, raw string")
    done = {(r.row_id, r.tok_idx): (r.pred, r.changed) for r in hints.apply_pairs(rows, hints.pairs(entries), F.col("raw") == "RT").collect()}
    assert done == {(1, 0): ("you", True), (1, 1): ("RT", False), (1, 2): ("ok", False), (1, 3): ("r", False), (1, 4): ("x", False), (2, 0): ("u", False)}
    named = hints.with_candidates(rows, hints.hints(entries)).withColumn("text", hints.hint_text())
    got = {(r.lang, r.raw): (r.candidate, r.text) for r in named.collect()}
    assert got["en", "r"][0] and json.loads(got["en", "r"][1])[0]["source"] == "review_pairs"
    assert got["en", "u"][0] and got["en", "u"][1] is None  # by the language's rules
    assert not got["en", "x"][0]


def test_labels(spark):
    df = spark.createDataFrame([(["u", "ok", "x"], ["you", "ok"], [None, 0, 0, 1, None, 1, None, None])], "raw array<string>, norm array<string>, word_ids array<int>")
    made = df.withColumn("labels", labels.changed_labels()).withColumn("pieces", labels.piece_labels()).first()
    assert made["labels"] == [1, 0]
    assert made["pieces"] == [-100, 1, -100, 0, -100, 0, -100, -100]
    empty = spark.createDataFrame([([], [], [])], df.schema).withColumn("labels", labels.changed_labels()).withColumn("pieces", labels.piece_labels()).first()
    assert empty["labels"] == [] and empty["pieces"] == []


def test_templates():
    t = {("id", "normalization"): "id", ("iden", "normalization"): "iden", (None, "normalization"): "any"}
    assert [prompts.resolve(t, x) for x in ("iden", "id", "de")] == ["id", "id", "any"]
    with pytest.raises(LookupError):
        prompts.resolve(t, "de", "detection")


def test_settings(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# x\nLEXMILL_WORK='w'\nno value\nLEXMILL_THRESHOLD=0.7\nLEXMILL_LOG=\n")
    made = config.Settings.load({"LEXMILL_WORK": " env ", "LEXMILL_LOG": ""}, str(file))
    assert (made.work, made.threshold, made.log) == ("env", 0.7, config.Settings.log)
    assert config.Settings.load({}, str(tmp_path / "none")) == config.Settings()


def test_numbered_and_nested_keys(spark, tmp_path):
    for n in (0, 1, 997):
        df = spark.range(n, numPartitions=5).select((F.col("id") * 2).alias("x"))
        assert sorted((r.row_id, r.x) for r in readers.numbered(df).collect()) == [(k, 2 * k) for k in range(n)]
    (tmp_path / "n.json").write_text('{"prediction": {"predictions": [{"normalized": {"pred": ["a"]}}, ["b"]]}}')
    assert [(r.row_id, r.pred) for r in readers.predictions(spark, str(tmp_path / "n.json")).orderBy("row_id").collect()] == [(0, ["a"]), (1, ["b"])]
    writers.statistics(spark.createDataFrame([("en", "u", 1), ("de", "v", 2)], "lang string, raw string, c int"), str(tmp_path / "s"))
    assert [tuple(r) for r in readers.statistics(spark, str(tmp_path / "s"), ["de"]).collect()] == [("de", "v", 2)]
    writers.metrics_csv([], str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("en", "u", "you", "you"), ("en", "r", "are", "r"), ("de", "a", "a", "b")], "lang string, raw string, norm string, pred string")
    measured = evaluate.by_language(rows)
    short = evaluate.with_short_names(measured).where("lang = 'en'").first()
    assert (short.tp, short.fn, short.precision, short.recall, short.err) == (1, 1, 1.0, 0.5, 0.5)
    assert {r.lang for r in evaluate.language_rows(measured, "d", "m").collect()} == {"en", "de"}
    (one,) = evaluate.overall_rows(measured, "d", "m", "n").collect()
    assert (one.total, one.n_langs, one.notes, one.dataset_name) == (3, 2, "n", "d")
    lines = evaluate.as_table(measured).split("\n")
    assert len(lines) == 4 and lines[1].startswith("__overall__")
    assert {r.pred for r in evaluate.unchanged(rows).collect()} == {"u", "r", "a"}


def test_commands_from_mining_to_submission(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    train = [(["u", "r", "ok"], ["you", "are", "ok"], "en")] * 3
    gold = [(["u", "ok"], ["you", "ok"], "en"), ([], [], "en"), (["zz", "r", "qq", "ww"], ["zz", "are", "qa", "ww"], "en")]
    for name, rows in (("t.parquet", train), ("g.parquet", gold)):
        spark.createDataFrame(rows, SENTENCE).coalesce(1).write.parquet(p(name))
    run = lambda *a: cli.main([*a], spark)
    (tmp_path / "echo_client.py").write_text("def make():\n    return lambda prompt: '{\"normalized\": \"FIX\"}'\n")
    spark.sparkContext.addPyFile(p("echo_client.py"))
    mined = ("--train", p("t.parquet"), "--input", p("g.parquet"), "--work", p("w"))
    run("mine", *mined, "--threshold", "0.0")
    hard = spark.read.json(p("w/hard"))
    assert {(r.row_id, r.token) for r in hard.collect()} == {(0, "ok"), (2, "zz"), (2, "qq"), (2, "ww")}
    rest = ("--input", p("g.parquet"), "--work", p("w"), "--log", p("log"))
    run("correct", *rest, "--client", "echo_client:make")
    run("correct", *rest, "--client", "echo_client:make", "--resume")
    assert readers.corrections(spark, p("log")).count() == 4

    def submitted(*switches):
        run("build", *rest, "--submission", p("s.zip"), *switches)
        with zipfile.ZipFile(p("s.zip")) as z:
            return [r["pred"] for r in json.loads(z.read("predictions.json"))]

    assert submitted("--no_llm") == [["you", "ok"], [], ["zz", "are", "qq", "ww"]]
    assert submitted() == [["you", "FIX"], [], ["FIX", "are", "FIX", "FIX"]]
    run("mine", *mined, "--no-trigram", "--no-mfr")
    assert submitted("--no_llm") == [["u", "ok"], [], ["zz", "r", "qq", "ww"]]


def test_commands_that_report(spark, tmp_path, capsys):
    p = lambda name: str(tmp_path / name)
    rows = [(["u", "ok"], ["you", "ok"], "en"), (["r"], ["are"], "da")]
    spark.createDataFrame(rows, SENTENCE).coalesce(1).write.parquet(p("g.parquet"))
    (tmp_path / "p.jsonl").write_text('["you"]\n["r", "x"]\n')
    cli.main(["score", "--gold", p("g.parquet"), "--pred", p("p.jsonl"), "--name", "mine"], spark)
    assert capsys.readouterr().out.startswith("mine\nlang")
    cli.main(["evaluate", "--gold", p("g.parquet"), "--pred", p("p.jsonl"), "--model-name", "m", "--out", p("e")], spark)
    got = {(r.eval_group, r.lang): (r.tp, r.fn) for r in spark.read.csv(p("e/languages"), header=True, inferSchema=True).collect()}
    assert got == {("all", "en"): (1, 0), ("all", "da"): (0, 1), ("official12", "en"): (1, 0), ("missing5", "da"): (0, 1)}
    assert spark.read.json(p("e/overall")).count() == 3
    cli.main(["evaluate", "--gold", p("g.parquet"), "--baseline", "mfr", "--train", p("g.parquet"), "--eval_groups", "all", "--out", p("m")], spark)
    assert [r.accuracy for r in spark.read.json(p("m/overall")).collect()] == [1.0]
    cli.main(["stats", "--gold", p("g.parquet"), "--train", p("g.parquet"), "--out", p("st")], spark)
    assert spark.read.csv(p("st/coverage"), header=True).count() == 2
    cli.main(["ablation", "--train", p("g.parquet"), "--input", p("g.parquet"), "--mode", "full", "--output", p("a")], spark)
    made = spark.read.csv(p("a"), header=True, inferSchema=True)
    assert made.count() == 44 and {r.err for r in made.collect()} == {1.0}


def test_sentences_without_tokens_count(spark):
    rows = [(1, ["a", "b"], ["a", "c"], "en"), (2, [], [], "en"), (3, [], [], "de"), (4, [], [], None)]
    made = profile.by_language(spark.createDataFrame(rows, "row_id bigint, " + SENTENCE))
    got = {r.lang: (r.num_samples, r.total_tokens, r.max_sentence_len, r.avg_sentence_len, r.changed_ratio, r.lai_accuracy) for r in made.collect()}
    assert got == {"en": (2, 2, 2, 1.0, 0.5, 0.5), "de": (1, 0, 0, 0.0, 0.0, 1.0), None: (1, 0, 0, 0.0, 0.0, 1.0)}
