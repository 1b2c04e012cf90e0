"""Look-ups in one shuffle: against the joins, in parts, and what they shuffle."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.operators import ngram, replace, together, tokens
from lexmill.plans import catalog
from test_catalog import plain, tables  # noqa: F401


def wide_exchanges(df):
    """The exchanges of a plan that hash-partition rows holding a context."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line and ("prev#" in line or "next#" in line or "REPARTITION_BY_COL" in line)]


def in_sql(name, tables):  # noqa: F811
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tables}/documents.parquet/*.parquet'")
    return con.sql(catalog.SQL[name])


def check(spark, tables, monkeypatch, name, exchanges=1):  # noqa: F811
    """One shuffle of tokens, and the SQL's rows, at once and in parts."""
    if exchanges is not None:
        assert len(wide_exchanges(catalog.QUERIES[name](spark, tables))) == exchanges
    monkeypatch.setattr(catalog, "PART_FROM", 0)
    got, want = catalog.QUERIES[name](spark, tables), in_sql(name, tables)
    assert "part" in " ".join(got.inputFiles())
    columns = sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_like_the_joins(spark, tables):  # noqa: F811
    rows = catalog.token_rows(spark, tables)
    odd = spark.createDataFrame([(200, None, i, "the", "The", "a", "b", i % 2 == 0, 2) for i in range(2)], "row_id bigint, lang string, tok_idx int, raw string, norm string, prev string, next string, val boolean, n_tok int")
    rows = rows.unionByName(odd)
    train, val = rows.where("not val"), rows.where("val")
    want = replace.look_up(ngram.look_up(val, ngram.tables(train)), replace.statistics(train), "top_norm", "confidence", "candidates")
    for parts in (1, 3):
        done = [together.with_statistics(together.with_levels(together.placed(rows, k, parts))) for k in range(parts)]
        got = [r for d in done for r in d.select(*[c for c in want.columns if c != "n_tok"]).collect()]
        assert plain(got) == plain(want.drop("n_tok").collect())
        assert len(got) > 200


def test_q15_one_shuffle(spark, tables, monkeypatch):  # noqa: F811
    check(spark, tables, monkeypatch, "q15_ngram_predict")


def test_q16_one_shuffle(spark, tables, monkeypatch):  # noqa: F811
    check(spark, tables, monkeypatch, "q16_ngram_hits")


@pytest.mark.parametrize("name", ["q23_cascade", "q24_hard_cases", "q25_hard_case_categories"])
def test_predictions_one_shuffle(spark, tables, monkeypatch, name):  # noqa: F811
    check(spark, tables, monkeypatch, name)


@pytest.mark.parametrize("name", ["q30_sweep_tri_only", "q31_sweep_full"])
def test_sweep_reads_kept_kinds(spark, tables, monkeypatch, name):  # noqa: F811
    check(spark, tables, monkeypatch, name, 0)


@pytest.mark.parametrize("name", ["q32_submission_summary", "q45_overlay_policies", "q46_resume", "q47_stale_corrections"])
def test_logs_read_kept_predictions(spark, tables, monkeypatch, name):  # noqa: F811
    check(spark, tables, monkeypatch, name, 0)


def test_prompts_one_shuffle(spark, tables, monkeypatch):  # noqa: F811
    """The same prompts at once and in parts; training sentences have none and aren't sent."""
    at_once = catalog.QUERIES["q43_prompt_lengths"](spark, tables)
    assert len(wide_exchanges(at_once)) == 1
    want = plain(at_once.collect())
    monkeypatch.setattr(catalog, "PART_FROM", 0)
    assert plain(catalog.QUERIES["q43_prompt_lengths"](spark, tables).collect()) == want and want
    assert {r.row_id % 5 for r in catalog.case_sentences(spark, tables).collect()} == {0}


def without_placing(spark, tables, monkeypatch, name):  # noqa: F811
    """Above the bound no token is dealt by its form, whose tokens one task would sort; the rows are the SQL's, where there is one."""
    want = plain(catalog.QUERIES[name](spark, tables).collect()) if name not in catalog.SQL else None
    monkeypatch.setattr(catalog, "PART_FROM", 0)
    monkeypatch.setattr(together, "placed", lambda *_: pytest.fail("tokens were dealt by their form"))
    got = catalog.QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    if want is None:
        assert plain(got.select(*columns).collect()) == plain(in_sql(name, tables).select(*[f'"{c}"' for c in columns]).fetchall())
    else:
        assert plain(got.collect()) == want and want


def test_f5_q25_hard_case_categories(spark, tables, monkeypatch):  # noqa: F811
    without_placing(spark, tables, monkeypatch, "q25_hard_case_categories")


def test_levels_where_a_context_tells(spark):
    """Levels of tokens with a telling context are those of the joins; the others keep their form at any threshold from 0.5."""
    from lexmill.operators import telling

    text = [("a b C", "a B C"), ("a b C", "a B C"), ("a b d", "a b d"), ("x b C", "x B C"), ("a q r", "a q r")]
    rows = [(i, lang, i, s.split()[i % 3], n.split()[i % 3], p, x, i % 2 == 0) for i, (s, n) in enumerate(text * 12) for lang in ("en", None) for p in ("a", "x") for x in ("C", "d")]
    tokens_ = spark.createDataFrame(rows, "row_id bigint, lang string, tok_idx int, raw string, norm string, prev string, next string, val boolean")
    got = telling.with_levels(spark, tokens_, 1 << 20)
    want = ngram.look_up(tokens_.where("val"), ngram.tables(tokens_.where("not val and lang is not null")))
    keys = ["row_id", "tok_idx", "lang", "raw", "prev", "next"]
    for variant in ngram.VARIANTS:
        for least in (0.5, 0.7, 1.0):
            told = [sorted(map(str, ngram.decide(d, ngram.Config(variant, least)).select(*keys, "tri_pred").collect())) for d in (got, want)]
            assert told[0] == told[1]
    assert got.where("raw <> biL_norm").count() and got.where("biL_norm is null").count()


@pytest.mark.parametrize(
    "name",
    [
        pytest.param("q30_sweep_tri_only", id="f6"),
        pytest.param("q31_sweep_full", id="f7"),
        pytest.param("q32_submission_summary", id="f8"),
        pytest.param("q43_prompt_lengths", id="f9"),
        pytest.param("q45_overlay_policies", id="f10"),
        pytest.param("q46_resume", id="f11"),
    ],
)
def test_f6_to_f11_without_placing(spark, tables, monkeypatch, name):  # noqa: F811
    without_placing(spark, tables, monkeypatch, name)


def only_told(spark, tables, monkeypatch, name):  # noqa: F811
    """Above the bound no statistics of all forms are made for tokens that keep their form, and the rows are the SQL's."""
    monkeypatch.setattr(catalog, "PART_FROM", 0)
    monkeypatch.setattr(replace, "statistics", lambda *_: pytest.fail("every form was counted"))
    got = catalog.QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(in_sql(name, tables).select(*[f'"{c}"' for c in columns]).fetchall())


def test_f7_q31_counts_telling_forms_only(spark, tables, monkeypatch):  # noqa: F811
    only_told(spark, tables, monkeypatch, "q31_sweep_full")


def joined_rows_only(spark, tables, monkeypatch, name):  # noqa: F811
    """As ``only_told``; and the log is laid over tokens that have an entry, not over all."""
    bases, lay = [], catalog.cascade.overlay
    monkeypatch.setattr(catalog.cascade, "overlay", lambda base, log, *policy: bases.append(base) or lay(base, log, *policy))
    only_told(spark, tables, monkeypatch, name)
    every = catalog.token_rows(spark, tables).where("val").count()
    assert bases and all(0 < b.count() < every for b in bases)


def test_f8_q32_joins_tokens_with_entries(spark, tables, monkeypatch):  # noqa: F811
    joined_rows_only(spark, tables, monkeypatch, "q32_submission_summary")


def test_f9_q43_candidates_of_hard_cases_only(spark, tables, monkeypatch):  # noqa: F811
    """The same prompts; levels aren't carried into the join with the candidates, and only hard cases are."""
    want = plain(catalog.QUERIES["q43_prompt_lengths"](spark, tables).collect())
    asked, look = [], replace.look_up
    monkeypatch.setattr(catalog, "PART_FROM", 0)
    monkeypatch.setattr(replace, "look_up", lambda rows, *a: asked.append(rows) or look(rows, *a))
    assert plain(catalog.QUERIES["q43_prompt_lengths"](spark, tables).collect()) == want and want
    assert [r.count() for r in asked] == [len(want)] and "tri_norm" not in asked[0].columns


def test_f10_q45_joins_tokens_with_entries(spark, tables, monkeypatch):  # noqa: F811
    joined_rows_only(spark, tables, monkeypatch, "q45_overlay_policies")


def part_by_part(spark, tables, monkeypatch, name, module, operator, sides):  # noqa: F811
    """The operator gets the sentences part by part, each written before the next begins; predictions leave one table behind."""
    from lexmill.sources import interim

    got, call = [], getattr(module, operator)
    monkeypatch.setattr(catalog, "PART_FROM", 0)
    monkeypatch.setattr(module, operator, lambda *a: got.append((a[:sides], len(interim._written))) or call(*a))
    begun = len(interim._written)
    catalog.QUERIES[name](spark, tables)
    of = [[{r.row_id for r in side.select("row_id").distinct().collect()} for side in a] for a, _ in got]
    every = {r.row_id for r in catalog.case_sentences(spark, tables).collect()}
    assert all(ids < every for call_ in of for ids in call_) and set().union(*[call_[0] for call_ in of]) <= every
    parts = list(dict.fromkeys(frozenset(call_[-1]) for call_ in of))
    assert len(parts) > 1 and all(not a & b for i, a in enumerate(parts) for b in parts[:i])
    return got[0][1] - begun


def test_f8_q32_log_laid_over_in_parts(spark, tables, monkeypatch):  # noqa: F811
    # The predictions, the parts' folder and the first part's filter.
    assert part_by_part(spark, tables, monkeypatch, "q32_submission_summary", catalog.cascade, "overlay", 1) == 3


def test_f10_q45_log_laid_over_in_parts(spark, tables, monkeypatch):  # noqa: F811
    assert part_by_part(spark, tables, monkeypatch, "q45_overlay_policies", catalog.cascade, "overlay", 1) == 3


def test_f9_q43_prompts_made_in_parts(spark, tables, monkeypatch):  # noqa: F811
    """Cases and sentences of a part only are joined; the predictions, the forms' filter, their candidates and the parts' folder are left."""
    assert part_by_part(spark, tables, monkeypatch, "q43_prompt_lengths", catalog.prompts, "with_prompt", 2) == 4


def test_f10_q45_filters_sent_once(spark, tables):  # noqa: F811
    """Tasks that count levels carry each filter once, and count the tokens of the levels that are held."""
    from lexmill.operators import telling

    rows, every = catalog.token_rows(spark, tables), F.lit(True)
    few = rows.where("tok_idx < 3")
    asked = telling.contexts(spark, telling._hashes(few, biL=every, biR=every, form=every), 1 << 20)
    made = telling._by_level(rows, asked.hold("biL"), asked.hold("biR"), asked.hold("form"), "norm")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery") == 3
    held = {level: rows.where(asked.hold(level)).count() for level in ("biL", "biR", "form")}
    held["tri"] = rows.where(asked.hold("biL") & asked.hold("biR")).count()
    assert {r["level"]: r["count"] for r in made.groupBy("level").count().collect()} == held
