"""Statistics, prediction, guards, evaluation and overlays on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import ratio
from lexmill.operators import cascade, evaluate, fewshot, model, ngram, profile, prompts, replace, tokens

ROWS = "row_id bigint, lang string, raw array<string>, norm array<string>"


def tok(spark, rows):
    return tokens.explode(spark.createDataFrame(rows, ROWS))


def test_explode_and_back(spark):
    df = spark.createDataFrame([(1, "en", ["a", "b"], ["A", ""]), (2, "en", [], [])], ROWS)
    rows = tokens.explode(df).orderBy("tok_idx").collect()
    assert [(r.prev, r.raw, r.next) for r in rows] == [("<BOS>", "a", "b"), ("a", "b", "<EOS>")]
    assert tokens.reassemble(tokens.explode(df), "raw", "norm").collect()[0]["norm"] == ["A", ""]


def test_alignment(spark):
    df = spark.createDataFrame([(1, "en", ["a", "b"], ["x"]), (2, "en", ["a"], ["x", "y"]), (3, "en", ["a"], ["b"])], ROWS)
    assert [r.row_id for r in tokens.align(df, "skip").collect()] == [3]
    assert [r.norm for r in tokens.align(df, "pad").orderBy("row_id").collect()] == [["x", "b"], ["x"], ["b"]]
    with pytest.raises(Exception, match="differ in length"):
        tokens.align(df, "strict").collect()
    with pytest.raises(ValueError):
        tokens.align(df, "other")


def test_replacement_ties_go_to_the_first_in_order(spark):
    df = tok(spark, [(1, "en", ["u", "u", "u"], ["you", "u", "you"]), (2, "en", ["r", "r"], ["b", "a"])])
    got = {r.raw: (r.top_norm, r.top_count, r.total) for r in replace.dictionary(df).collect()}
    assert got == {"u": ("you", 2, 3), "r": ("a", 1, 2)}
    stats = {r.raw: r for r in replace.statistics(df).collect()}
    assert stats["u"].confidence == pytest.approx(2 / 3) and stats["u"].margin == pytest.approx(1 / 3)
    assert stats["r"].change_rate == 1.0 and stats["r"].entropy == pytest.approx(0.693147, abs=1e-6)


def test_ngram_ties_go_to_the_first_seen(spark):
    df = tok(spark, [(1, "en", ["x", "u"], ["x", "z"]), (2, "en", ["x", "u"], ["x", "a"])])
    assert [r.norm for r in ngram.best(ngram.counts(df, "biL"), "biL").where("raw = 'u'").collect()] == ["z"]


def test_back_off(spark):
    train = tok(spark, [(1, "en", ["a", "u", "b"], ["a", "L", "b"]), (2, "en", ["a", "u", "c"], ["a", "L", "c"]), (3, "en", ["d", "u", "e"], ["d", "R", "e"]), (4, "en", ["f", "u", "e"], ["f", "R", "e"]), (5, "en", ["g", "u", "h"], ["g", "u", "h"])])
    levels = ngram.tables(train)
    ask = tok(spark, [(9, "en", ["a", "u", "e"], ["", "", ""]), (10, "en", ["g", "u", "h"], ["", "", ""]), (11, "fr", ["a", "u", "b"], ["", "", ""])]).where("tok_idx = 1")
    got = {r.row_id: (r.source, r.tri_pred) for r in ngram.predict(ask, levels).collect()}
    assert got == {9: ("biL", "L"), 10: ("tri", "u"), 11: ("none", "u")}
    right = {r.row_id: r.source for r in ngram.predict(ask, levels, ngram.Config("tri_biR")).collect()}
    assert right[9] == "biR"
    with pytest.raises(ValueError):
        ngram.predict(ask, levels, ngram.Config("other"))


GUARD = "lang string, raw string, top_norm string, confidence double, total bigint, change_rate double, margin double, entropy double"


def test_second_guard(spark):
    rows = [
        ("id", "@x", "[mention]", 0.1, True), ("id", "anak2", "anak-anak", 0.1, True), ("hr", "x2", "xx", 0.5, True), ("hr", "x2", "xx", 0.4, False),
        ("en", "1030", "10:30", 0.5, True), ("ja", "…", "。", 0.9, False), ("ja", "…", "。", 0.95, True), ("en", "10:30", "x", 0.79, False),
        ("en", "10:30", "x", 0.8, True), ("en", "u", "you", 0.0, True), ("en", "u", None, None, False),
    ]
    df = spark.createDataFrame([(*r[:4], 1, 0.0, 0.0, 0.0, r[4]) for r in rows], GUARD + ", want boolean")
    assert not df.where(replace.guard_two_rule() != F.col("want")).collect()


def test_first_guard(spark):
    df = spark.createDataFrame([("de", "a", "b", 0.9, 3, 0.7, 0.3, 0.6), ("de", "a", None, None, None, None, None, None)], GUARD)
    got = lambda mode, v=None: [r[0] for r in df.select(replace.guard_one_rule(mode, v)).collect()]
    assert got("base") == [True, False] and got("change_guard") == [False, False] and got("confidence_guard") == [True, False]
    assert got("margin_guard") == [True, False] and got("entropy_guard") == [False, False] and got("margin_guard", {"min_count": 4}) == [False, False]
    with pytest.raises(ValueError):
        replace.guard_one_rule("other")


def test_cascade_keeps_deletions(spark):
    df = spark.createDataFrame([("a", "a", ""), ("a", "b", "c"), ("a", None, None)], "raw string, t string, m string")
    assert [r[0] for r in df.select(cascade.cascade("t", "m")).collect()] == ["", "b", "a"]
    with pytest.raises(ValueError):
        cascade.cascade(None, None)


def test_wrong_changes_count_twice(spark):
    df = spark.createDataFrame([("en", "a", "b", "c"), ("en", "a", "b", "b"), ("en", "a", "a", "x"), ("en", "a", "a", "a"), ("en", "a", "b", "a")], "lang string, raw string, norm string, pred string")
    r = evaluate.by_language(df).where("lang = 'en'").collect()[0]
    assert (r.total, r.correct, r.tp, r.fp, r.fn, r.tn) == (5, 2, 1, 2, 2, 1)
    assert r.tp + r.fp == r.pred_changed and r.tp + r.fn == r.gold_changed


@pytest.mark.parametrize(
    ("total", "correct", "tp", "fp", "fn", "err", "p", "r", "f1"),
    [(125377, 119511, 9657, 2519, 4787, 0.494184, 0.793118, 0.668582, 0.725545)],
)
def test_published_values(spark, total, correct, tp, fp, fn, err, p, r, f1):
    df = spark.createDataFrame([(total, correct, total - tp - fn, tp + fn, tp + fp, tp, fp, fn, 0)], ", ".join(f"{c} bigint" for c in evaluate.COUNTS))
    got = df.select(*evaluate.metrics()).collect()[0]
    assert got.err == pytest.approx(err, abs=1e-6)
    assert (got.detection_precision, got.detection_recall, got.detection_f1) == pytest.approx((p, r, f1), abs=1e-6)


def test_views_and_macro(spark):
    df = spark.createDataFrame([("en", "a", "b", "b"), ("da", "a", "b", "a")], "lang string, raw string, norm string, pred string")
    got = {(r.eval_group, r.lang): r.err for r in evaluate.by_language(evaluate.with_views(df), "eval_group").collect()}
    assert got[("all", "__overall__")] == 0.5 and got[("official12", "__overall__")] == 1.0 and got[("missing5", "da")] == 0.0
    assert evaluate.macro(evaluate.by_language(df)).collect()[0].macro_err == 0.5
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0))).collect()[0][0] == 0.0


LOG = "row_id bigint, tok_idx int, token string, seq bigint, normalized string"


def test_overlays(spark):
    base = spark.createDataFrame([(1, 0, "u", "u"), (1, 1, "r", "r"), (1, 2, "x", "x")], "row_id bigint, tok_idx int, raw string, base_pred string")
    log = spark.createDataFrame([(1, 0, "u", 1, "you"), (1, 0, "u", 2, "u"), (1, 1, "r", 1, "are"), (1, 1, "r", 2, None), (1, 2, "x", 1, ""), (7, 7, "z", 1, "zz")], LOG)
    got = lambda policy: [r.pred for r in cascade.overlay(base, log, policy).orderBy("tok_idx").collect()]
    assert got("changes") == ["you", "are", ""] and got("latest") == ["u", "are", ""]
    assert cascade.stale(base, log).count() == 1 and cascade.todo(base, log.where("tok_idx = 1")).count() == 2
    with pytest.raises(ValueError):
        cascade.overlay(base, log, "other")


def test_dictionary_classes_and_patterns(spark):
    df = tok(spark, [(1, "en", ["u", "u", "u", "t", "t", "k", "k", "k", "k"], ["you", "you", "u", "ta", "to", "kk", "k", "k", "k"])])
    got = {r.raw: (r.norm, r["class"]) for r in profile.classes(df).collect()}
    assert got == {"u": ("you", "high"), "t": ("ta", "ambiguous"), "k": ("kk", "review")}
    pairs = spark.createDataFrame([("a", ""), ("a", "A"), ("ab", "a b"), ("cafe", "café"), ("dont", "don't"), ("a.", "a"), ("l8", "late"), ("pls", "please"), ("abcd", "ab"), ("ab", "cd")], "raw string, norm string")
    assert [r[0] for r in pairs.select(profile.pattern()).collect()] == [
        "empty_norm_alignment", "case_change", "whitespace_change", "accent_or_diacritic_restore", "apostrophe_or_contraction_change", "punctuation_change",
        "digit_related_change", "expansion_or_abbreviation_restore", "shortening_or_deletion", "other_substitution",
    ]


def test_few_shots_against_brute_force(spark):
    rows = [(i, "en", [w, "q"], [w.upper(), "q"]) for i, w in enumerate(["cat", "cart", "bat", "dog", "cat", "cut", "zzzz"])]
    sentences = spark.createDataFrame([(r[0], " ".join(r[2])) for r in rows], "row_id bigint, text string")
    targets = spark.createDataFrame([(1, "en", "cat", "cat x"), (2, "en", "dig", None), (3, "fr", "cat", "x")], "target_id bigint, lang string, form string, text string")
    got: dict = {}
    for r in fewshot.retrieve(targets, fewshot.pool(tok(spark, rows)), sentences, 3, 4).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append((r.row_id, r.dist))
    assert got == {1: [(0, 0), (4, 0), (2, 1)], 2: [(3, 1), (0, 2), (4, 2)]} or got[1][:2] == [(0, 0), (4, 0)] and got[1][2][1] == 1 and got[2][0] == (3, 1)
    assert fewshot.retrieve(targets, fewshot.pool(tok(spark, rows)), sentences, 0).count() == 0


def test_model_boundaries(spark):
    sent = spark.createDataFrame([(1, ["aa", "b"]), (2, None)], "row_id bigint, raw array<string>")
    assert [(r.tok_idx, r.p) for r in model.noise_scores(sent).orderBy("tok_idx").collect()] == [(0, 0.4), (1, 0.0)]
    cases = spark.createDataFrame([(1, 0, "en", "aa")], "row_id bigint, tok_idx int, lang string, token string")
    asked = prompts.with_prompt(cases, sent)
    assert "Target: aa" in asked.collect()[0].prompt and "Protected: []" in asked.collect()[0].prompt
    good = model.correct(asked, lambda: lambda p: 'x {"normalized": "AA"}').collect()[0]

    def broken():
        def ask(prompt):
            raise OSError("down")

        return ask

    bad = model.correct(asked, broken).collect()[0]
    assert good.normalized == "AA" and bad.normalized is None and bad.error == "OSError: down"
