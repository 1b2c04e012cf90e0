"""Queries over the derived corpus, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mean_of_rounded, ratio, reduce_runs, expand_repetition, lang_code, strong_protect, weak_protect
from ..operators import candidates, cascade, evaluate, fewshot, hints, labels, ngram, profile, prompts, replace, telling, together, tokens
from ..sources import interim
from . import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    """Register a query under a name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir: str) -> DataFrame:
    return tokens.derived_sentences(table(spark, sf_dir, "documents"))


def token_rows(spark, sf_dir: str) -> DataFrame:
    return tokens.explode(corpus(spark, sf_dir), "val")


def halves(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = token_rows(spark, sf_dir)
    return rows.where("not val"), rows.where("val")


#: Documents of more bytes go through the shuffle in so many parts of the forms; each reads the whole input.
PART_FROM, PARTS = 64 << 20, 4


def bytes_of(spark, sf_dir: str) -> int:
    return int(str(table(spark, sf_dir, "documents")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_of(spark, sf_dir: str) -> int:
    return PARTS if bytes_of(spark, sf_dir) > PART_FROM else 1


def in_parts(spark, sf_dir: str, make, keep: bool = False) -> DataFrame:
    """``make`` of all tokens, placed by form: where they are many, in parts that are written one after the other; ``keep`` writes in any case."""
    rows, parts = token_rows(spark, sf_dir), parts_of(spark, sf_dir)
    if parts == 1 and not keep:
        return make(together.placed(rows))
    return interim.in_parts(spark, lambda k: make(together.placed(rows, k, parts)), parts)


def predicted(spark, sf_dir: str, make, keep: bool = False) -> DataFrame:
    """``make`` of all validation tokens with both predictions; where tokens are many, only those that a context or form may change are looked up.

    The others have their raw form as both predictions, and no candidates are given there.
    """
    rows, size = token_rows(spark, sf_dir), bytes_of(spark, sf_dir)
    if size <= PART_FROM:
        return in_parts(spark, sf_dir, lambda placed: make(both_predictions(placed)), keep)

    def every():
        told, rest = telling.split(spark, rows, size)
        # Written, so that no later expression repeats the patterns of the protection.
        told = interim.once(spark, predictions(ngram.with_protection(told)))
        rest = ngram.with_protection(rest).withColumns({"tri_pred": F.col("raw"), "mfr_pred": F.col("raw")})
        return make(told.unionByName(rest, allowMissingColumns=True))

    if not keep:
        return every()
    with interim.last_only():
        return interim.once(spark, every())


def cases(spark, sf_dir: str, make, keep: bool = False) -> DataFrame:
    """``make`` of all hard cases; where tokens are many, candidates are counted and looked up for the forms of hard cases only.

    ``keep`` writes these hard cases first, without neighbours and norm.
    """
    size = bytes_of(spark, sf_dir)
    if size <= PART_FROM:
        return predicted(spark, sf_dir, lambda told: make(hard_cases(told)))
    columns = ["row_id", "tok_idx", "lang", "raw", *([] if keep else ["prev", "next", "norm"])]
    hard = predicted(spark, sf_dir, lambda told: mined(told).where("hard").select(*columns), keep)
    train = token_rows(spark, sf_dir).where("not val").where(telling.forms_of(spark, hard, size).hold("form"))
    stats = interim.once(spark, replace.statistics(train).select("lang", "raw", replace.category().alias("cat"), replace.top_candidates().alias("top5")))
    found = replace.look_up(hard, stats, "cat", "top5").withColumnRenamed("raw", "token")
    return make(found.withColumns({"cat": F.coalesce("cat", F.lit("mfr_oov")), "mfr_top5": F.coalesce("top5", F.lit(""))}).drop("top5"))


def by_sentences(spark, sf_dir: str, make) -> DataFrame:
    """All rows of ``make``, which gets a function that keeps the sentences of a part: where tokens are many, the parts are written one after the other."""
    parts = parts_of(spark, sf_dir)
    if parts == 1:
        return make(lambda rows: rows)
    return interim.in_parts(spark, lambda k: make(lambda rows: rows.where(F.pmod(F.xxhash64("row_id"), F.lit(parts)) == k)), parts)


def added(counted: DataFrame, *keys: str) -> DataFrame:
    """Counts of parts, added."""
    return counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counted.columns if c not in keys])


def mfr_scored(spark, sf_dir: str) -> DataFrame:
    train, val = halves(spark, sf_dir)
    return replace.predict(val, replace.dictionary(train))


@query("q01_token_profile", f"with {sql.TOK} select lang, count(*) as tokens, count(distinct row_id) as rows_, max(n_tok) as max_len, round(count(*) * 1.0::double / count(distinct row_id), 6) as avg_len from tok group by lang")
def token_profile(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("lang", F.size("raw").alias("n")).where("n > 0")
    return rows.groupBy("lang").agg(
        F.sum("n").alias("tokens"), F.count("*").alias("rows_"), F.max("n").cast("bigint").alias("max_len"), F.round(F.avg("n"), 6).alias("avg_len")
    )


@query("q02_context_neighbours", f"with {sql.TOK} select lang, prev, next, count(*) as c from tok group by all")
def context_neighbours(spark, sf_dir):
    return token_rows(spark, sf_dir).groupBy("lang", "prev", "next").agg(F.count("*").alias("c"))


@query("q03_reassemble", f"with {sql.TOK} select row_id, lang, md5(string_agg(raw, ' ' order by tok_idx)) as raw_md5, md5(string_agg(norm, ' ' order by tok_idx)) as norm_md5 from tok group by all")
def reassemble(spark, sf_dir):
    made = tokens.reassemble(token_rows(spark, sf_dir), "raw", "norm")
    return made.select("row_id", "lang", *[F.md5(F.array_join(c, " ").cast("binary")).alias(f"{c}_md5") for c in ("raw", "norm")])


_CODES = "case doc_id % 8 when 0 then 'ID-EN' when 1 then 'id_en' when 2 then 'TR-de' when 3 then 'tr_de' when 4 then 'IDEN' when 5 then null when 6 then ' EN ' else lang end"


@query("q04_lang_alias", f"select case when c in ('id-en', 'id_en') then 'iden' when c in ('tr-de', 'tr_de') then 'trde' else c end as code, count(*) as n from (select trim(lower(coalesce({_CODES}, ''))) as c from documents where doc_id is not null) group by 1")
def lang_alias(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return docs.select(lang_code(F.expr(_CODES)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


_BENT = "case when row_id % 7 = 0 then {cut} when row_id % 11 = 0 then {add} else {same} end"


@query("q05_align_modes", f"""with {sql.SENT}, s as (select row_id, lang, toks as raw, case when row_id % 7 = 0 then toks[1:len(toks) - 1] when row_id % 11 = 0 then list_append(toks, 'x') else toks end as norm from sent)
select 'skip' as mode, count(*) as rows_, cast(sum(len(norm)) as bigint) as toks from s where len(raw) = len(norm) and len(raw) > 0
union all select 'pad', count(*), cast(sum(len(raw)) as bigint) from s""")
def align_modes(spark, sf_dir):
    sent = corpus(spark, sf_dir).withColumn("raw", F.col("norm"))
    cut = F.when(F.size("norm") > 0, F.slice("norm", F.lit(1), F.greatest(F.size("norm") - 1, F.lit(0)))).otherwise(F.col("norm"))
    bent = sent.withColumn("norm", F.when(F.col("row_id") % 7 == 0, cut).when(F.col("row_id") % 11 == 0, F.array_append("norm", F.lit("x"))).otherwise(F.col("norm")))
    made = [tokens.align(bent, m).agg(F.count("*").alias("rows_"), F.sum(F.size("norm")).alias("toks")).select(F.lit(m).alias("mode"), "rows_", "toks") for m in ("skip", "pad")]
    return made[0].unionByName(made[1])


@query("q06_mfr_dictionary", f"with {sql.MFR} select lang, raw, top_norm, top_count, cast(total as bigint) as total from mfr")
def mfr_dictionary(spark, sf_dir):
    return replace.dictionary(halves(spark, sf_dir)[0])


@query("q07_mfr_predict_changed", f"with {sql.MFR}, {sql.VAL} select lang, raw, pred, norm, count(*) as c from val where raw <> pred group by all")
def mfr_predict_changed(spark, sf_dir):
    return mfr_scored(spark, sf_dir).where("raw <> pred").groupBy("lang", "raw", "pred", "norm").agg(F.count("*").alias("c"))


@query("q08_confusion_by_lang", f"with {sql.MFR}, {sql.VAL} select lang, {sql.counts()} from val group by lang")
def confusion_by_lang(spark, sf_dir):
    return mfr_scored(spark, sf_dir).groupBy("lang").agg(*evaluate.confusion())


_EVAL = f"""with {sql.MFR}, {sql.VAL}, counted as (select coalesce(lang, '__overall__') as lang, {sql.counts()} from val group by grouping sets ((lang), ())),
  scored as (select lang, {sql.COUNT_NAMES}, {sql.METRICS} from {sql.WITH_PR})"""


@query("q09_err_metrics", f"{_EVAL} select * from scored")
def err_metrics(spark, sf_dir):
    return evaluate.by_language(mfr_scored(spark, sf_dir))


@query("q10_macro_metrics", f"{_EVAL} select count(*) as n_langs, {', '.join(f'{sql.mean(m)} as macro_{m}' for m in evaluate.MACROS)} from scored where lang <> '__overall__'")
def macro_metrics(spark, sf_dir):
    return evaluate.macro(evaluate.by_language(mfr_scored(spark, sf_dir)))


def _ngram_counts(level: str):
    def run(spark, sf_dir):
        return ngram.counts(halves(spark, sf_dir)[0], level)

    return run


for _level, _name, _keys in (("tri", "q11_ngram_tri", "lang, prev, raw, next"), ("biL", "q12_ngram_left", "lang, prev, raw"), ("biR", "q13_ngram_right", "lang, raw, next")):
    query(_name, f"with {sql.TOK} select {_keys}, norm, count(*) as c, min(row_id * 10000000 + tok_idx) as first_pos from tok where not val group by all")(_ngram_counts(_level))


@query("q14_ngram_best", f"with {sql.NGRAM} select lang, prev, raw, norm, cast(total as bigint) as total, round(conf, 6) as conf from bil where conf >= 0.7")
def ngram_best(spark, sf_dir):
    found = ngram.best(ngram.counts(halves(spark, sf_dir)[0], "biL"), "biL").where("conf >= 0.7")
    return found.withColumn("conf", F.round("conf", 6))


_VARIANTS = ", ".join(f"('{v}')" for v in ngram.VARIANTS)


@query("q15_ngram_predict", f"""with {sql.NGRAM}, {sql.JOINED}, p as (select *, {sql.CHOSEN} as pred from (select joined.*, v.variant, {sql.source("v.variant", "0.7")} as source from joined, (values {_VARIANTS}) v(variant)))
select variant, lang, source, count(*) as c, count(*) filter (where pred <> raw) as changed, count(*) filter (where pred = norm) as correct from p group by all""")
def ngram_predict(spark, sf_dir):
    def made(placed):
        joined = together.with_levels(placed).where("val").withColumn("protected", F.lit(False))
        every = joined.withColumn("variant", F.explode(F.array(*map(F.lit, ngram.VARIANTS))))
        told = every.withColumn("source", ngram.source(F.col("variant"), 0.7, False)).withColumn("pred", ngram.chosen(F.col("source")))
        return told.groupBy("variant", "lang", "source").agg(
            F.count("*").alias("c"), F.count_if(F.col("pred") != F.col("raw")).alias("changed"), F.count_if(F.col("pred") == F.col("norm")).alias("correct")
        )

    return added(in_parts(spark, sf_dir, made), "variant", "lang", "source")


@query("q16_ngram_hits", f"""with {sql.NGRAM}, {sql.JOINED}, p as (select *, {sql.source("'tri_bi_both'", "0.7", sql.strong())} as source from joined)
select lang, source, count(*) as tokens from p group by all""")
def ngram_hits(spark, sf_dir):
    def made(placed):
        told = ngram.decide(together.with_levels(placed).where("val"), ngram.Config(protect=True))
        return told.groupBy("lang", "source").agg(F.count("*").alias("tokens"))

    return added(in_parts(spark, sf_dir, made), "lang", "source")


@query("q17_ngram_size", f"with {sql.TOK}, t as (select * from tok where not val) " + " union all ".join(
    f"select '{level}' as level, lang, count(*) as keys from (select distinct {', '.join(keys)} from t) group by lang" for level, keys in ngram.LEVELS.items()))
def ngram_size(spark, sf_dir):
    tri = ngram.counts(halves(spark, sf_dir)[0])
    made = [tri.select(*keys).distinct().groupBy("lang").agg(F.count("*").alias("keys")).select(F.lit(level).alias("level"), "lang", "keys") for level, keys in ngram.LEVELS.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _protected(spark, sf_dir, rule):
    """Each distinct form is tested once."""
    forms = token_rows(spark, sf_dir).groupBy("lang", "raw").agg(F.count("*").alias("c"))
    return forms.withColumn("p", rule(F.col("raw"))).groupBy("lang").agg(F.sum(F.when(F.col("p"), F.col("c")).otherwise(0)).alias("protected"), F.sum("c").alias("tokens"))


@query("q18_weak_protect", f"with {sql.TOK} select lang, count(*) filter (where {sql.weak()}) as protected, count(*) as tokens from tok group by lang")
def weak_counts(spark, sf_dir):
    return _protected(spark, sf_dir, weak_protect)


@query("q19_strong_protect", f"with {sql.TOK} select lang, count(*) filter (where {sql.strong()}) as protected, count(*) as tokens from tok group by lang")
def strong_counts(spark, sf_dir):
    return _protected(spark, sf_dir, strong_protect)


@query("q20_mfr_statistics", f"with {sql.STATS} select lang, raw, top_norm, top_count, cast(total as bigint) as total, round(confidence, 6) as confidence, round(change_rate, 6) as change_rate, round(margin, 6) as margin, round(abs(entropy), 5) as entropy, top5 from stats")
def mfr_statistics(spark, sf_dir):
    made = replace.statistics(halves(spark, sf_dir)[0])
    return made.select("lang", "raw", "top_norm", "top_count", "total", *[F.round(c, 6).alias(c) for c in ("confidence", "change_rate", "margin")], F.round(F.abs("entropy"), 5).alias("entropy"), replace.top_candidates().alias("top5"))


_MODES = {"base": "true", "change_guard": "change_rate >= 0.75", "confidence_guard": "confidence >= 0.8", "margin_guard": "margin >= 0.2", "entropy_guard": "entropy <= 0.5", "combined_guard": "confidence >= 0.6 and change_rate >= 0.5 and margin >= 0.1 and entropy <= 0.69"}
_COMBINED = {"confidence": 0.6, "change_rate": 0.5, "margin": 0.1, "entropy": 0.69}


@query("q21_guard_one_modes", f"with {sql.STATS}, v as (select tok.lang, tok.raw, tok.norm, stats.* exclude (lang, raw) from tok left join stats using (lang, raw) where val) " + " union all ".join(
    f"select '{m}' as mode, lang, count(*) filter (where top_norm is not null and {rule} and top_norm <> raw) as changed, count(*) filter (where case when top_norm is not null and {rule} then top_norm else raw end = norm) as correct from v group by lang" for m, rule in _MODES.items()))
def guard_one_modes(spark, sf_dir):
    train, val = halves(spark, sf_dir)
    found = replace.look_up(val, replace.statistics(train), "top_norm", "total", "confidence", "change_rate", "margin", "entropy")
    preds = F.array(*[
        F.struct(F.lit(m).alias("mode"), F.when(replace.guard_one_rule(m, _COMBINED if m == "combined_guard" else None), F.col("top_norm")).otherwise(F.col("raw")).alias("pred"))
        for m in _MODES
    ])
    every = found.select("lang", "raw", "norm", F.explode(preds).alias("p"))
    return every.groupBy("p.mode", "lang").agg(F.count_if(F.col("p.pred") != F.col("raw")).alias("changed"), F.count_if(F.col("p.pred") == F.col("norm")).alias("correct"))


@query("q22_guard_two", f"""with {sql.STATS}, v as (select tok.lang, tok.raw, tok.norm, top_norm, confidence, {sql.strong("tok.raw")} as prot from tok left join stats using (lang, raw) where val),
g as (select *, case when top_norm is null then false when prot then case when starts_with(raw, '@') and top_norm = '[mention]' then true
  when regexp_full_match(raw, '[0-9]{{3,4}}') and regexp_matches(top_norm, '[.:]') then confidence >= 0.5 else confidence >= 0.8 end else confidence >= 0.0 end as applied from v)
select lang, prot as protected, applied, count(*) as tokens, count(*) filter (where case when applied then top_norm else raw end = norm) as correct from g group by all""")
def guard_two(spark, sf_dir):
    train, val = halves(spark, sf_dir)
    made = replace.guard_two(ngram.with_protection(val), replace.statistics(train))
    return made.groupBy("lang", "protected", "applied").agg(F.count("*").alias("tokens"), F.count_if(F.col("pred") == F.col("norm")).alias("correct"))


def both_predictions(placed: DataFrame, config: ngram.Config = ngram.Config()) -> DataFrame:
    """Validation tokens with ``tri_pred``, ``source``, the replacement's ``mfr_pred`` and its statistics, from placed tokens."""
    return predictions(together.with_statistics(together.with_levels(placed)), config)


def predictions(found: DataFrame, config: ngram.Config = ngram.Config()) -> DataFrame:
    """``both_predictions`` of tokens that have levels and statistics."""
    return replace.apply_two(ngram.decide(found, config)).withColumnRenamed("pred", "mfr_pred")


_G2 = """case when s.top_norm is null then j.raw when j.prot and not (case when starts_with(j.raw, '@') and s.top_norm = '[mention]' then true
  when regexp_full_match(j.raw, '[0-9]{3,4}') and regexp_matches(s.top_norm, '[.:]') then s.confidence >= 0.5 else s.confidence >= 0.8 end) then j.raw else s.top_norm end"""
_CASCADE = f"""{sql.STATS}, {sql.NGRAM[len(sql.TOK) + 2:]}, {sql.JOINED},
j as (select *, {sql.CHOSEN} as tri_pred, {sql.strong()} as prot from (select *, {sql.source("'tri_bi_both'", "0.7")} as source from joined)),
base as (select j.*, {_G2} as mfr_pred, s.top5, s.other, s.top_norm is not null as known from j left join stats s using (lang, raw)),
casc as (select *, coalesce(nullif(tri_pred, raw), nullif(mfr_pred, raw), raw) as base_pred, coalesce(nullif(mfr_pred, raw), nullif(tri_pred, raw), raw) as mfr_first,
  ((row_id * 7 + tok_idx * 13) % 10) / 10.0::double >= 0.5 as noisy from base)"""


@query("q23_cascade", f"with {_CASCADE} select lang, count(*) as tokens, count(*) filter (where base_pred = norm) as tri_first_correct, count(*) filter (where mfr_first = norm) as mfr_first_correct, count(*) filter (where base_pred <> mfr_first) as differ from casc group by lang")
def cascade_orders(spark, sf_dir):
    def made(told):
        both = told.select("lang", "norm", cascade.cascade("tri_pred", "mfr_pred").alias("a"), cascade.cascade("mfr_pred", "tri_pred").alias("b"))
        return both.groupBy("lang").agg(
            F.count("*").alias("tokens"), F.count_if(F.col("a") == F.col("norm")).alias("tri_first_correct"),
            F.count_if(F.col("b") == F.col("norm")).alias("mfr_first_correct"), F.count_if(F.col("a") != F.col("b")).alias("differ"),
        )

    return added(predicted(spark, sf_dir, made), "lang")


def noise():
    """Stands in for the noise model: a fixed share of positions."""
    return ((F.col("row_id") * 7 + F.col("tok_idx") * 13) % 10) / 10.0


def mined(told: DataFrame) -> DataFrame:
    made = told.withColumn("base_pred", cascade.cascade("tri_pred", "mfr_pred"))
    return made.withColumn("noisy", cascade.thresholds(noise())).withColumn("hard", cascade.is_hard(F.col("protected")))


def hard_cases(told: DataFrame) -> DataFrame:
    """Hard cases with why, their candidates and neighbours."""
    rows = mined(told).where("hard")
    return rows.select("row_id", "tok_idx", "lang", F.col("raw").alias("token"), "prev", "next", "norm", replace.category().alias("cat"), F.coalesce(replace.top_candidates(), F.lit("")).alias("mfr_top5"))


_HARD = f"{_CASCADE}, hard as (select *, case when not known then 'mfr_oov' when other then 'has_non_raw_cands' else 'all_cands_raw' end as cat from casc where noisy and not prot and base_pred = raw)"


@query("q24_hard_cases", f"with {_HARD} select hard.row_id, hard.tok_idx, hard.lang, hard.raw as token, t.prev, t.next, cat, coalesce(top5, '') as mfr_top5 from hard join tok t using (row_id, tok_idx)")
def hard_case_rows(spark, sf_dir):
    return cases(spark, sf_dir, lambda hard: hard.drop("norm"))


@query("q25_hard_case_categories", f"with {_HARD} select lang, cat, count(*) as c from hard group by all")
def hard_case_categories(spark, sf_dir):
    made = cases(spark, sf_dir, lambda hard: hard.groupBy("lang", "cat").agg(F.count("*").alias("c")))
    return added(made, "lang", "cat")


_DS = f"""{sql.TOK}, sn as (select lang as l, count(*) as num_samples, max(len(toks)) as max_sentence_len from sent group by lang),
tk as (select lang, count(*) as total_tokens, count(*) filter (where raw <> norm) as changed_tokens,
  count(distinct raw) as raw_vocab_size, count(distinct norm) as norm_vocab_size, count(*) filter (where norm = '') as empty_norm_tokens,
  count(*) filter (where raw <> norm and contains(norm, ' ')) as norm_contains_space_tokens, count(*) filter (where raw <> norm and contains(raw, ' ')) as raw_contains_space_tokens from tok group by lang),
ds as (select l as lang, num_samples, max_sentence_len, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("total_tokens", "changed_tokens", "raw_vocab_size", "norm_vocab_size", "empty_norm_tokens", "norm_contains_space_tokens", "raw_contains_space_tokens"))}
  from sn left join tk on sn.l is not distinct from tk.lang),
dsr as (select *, round({sql.div("total_tokens", "num_samples")}, 6) as avg_sentence_len, round({sql.div("changed_tokens", "total_tokens")}, 6) as changed_ratio,
  round(1 - {sql.div("changed_tokens", "total_tokens")}, 6) as lai_accuracy, round({sql.div("empty_norm_tokens", "total_tokens")}, 6) as empty_norm_ratio,
  round({sql.div("norm_contains_space_tokens", "total_tokens")}, 6) as norm_contains_space_ratio from ds)"""


@query("q26_dataset_stats", f"with {_DS} select * from dsr")
def dataset_stats(spark, sf_dir):
    return profile.by_language(corpus(spark, sf_dir))


@query("q27_coverage", f"""with {sql.MFR}, v as (select tok.lang, tok.raw, tok.norm, mfr.top_norm from tok left join mfr using (lang, raw) where val),
c as (select lang, count(*) as total_tokens, count(*) filter (where raw <> norm) as changed_tokens, count(*) filter (where top_norm is null) as raw_oov_tokens,
  count(*) filter (where raw <> norm and top_norm is null) as changed_raw_oov_tokens, count(*) filter (where top_norm is not null) as mfr_seen_tokens,
  count(*) filter (where coalesce(top_norm, raw) = norm) as mfr_correct_tokens, count(*) filter (where raw <> norm and top_norm is not null) as mfr_changed_seen_tokens,
  count(*) filter (where raw <> norm and coalesce(top_norm, raw) = norm) as mfr_changed_correct_tokens from v group by lang),
s as (select lang, count(*) as train_raw_vocab_size from mfr group by lang)
select c.*, coalesce(train_raw_vocab_size, 0) as train_raw_vocab_size, round(raw_oov_tokens * 1.0::double / total_tokens, 6) as raw_oov_ratio,
  round(changed_raw_oov_tokens * 1.0::double / greatest(1, changed_tokens), 6) as changed_raw_oov_ratio, round(mfr_seen_tokens * 1.0::double / total_tokens, 6) as mfr_seen_ratio,
  round(mfr_correct_tokens * 1.0::double / total_tokens, 6) as mfr_token_accuracy, round(mfr_changed_seen_tokens * 1.0::double / greatest(1, changed_tokens), 6) as mfr_changed_seen_ratio,
  round(mfr_changed_correct_tokens * 1.0::double / greatest(1, changed_tokens), 6) as mfr_changed_correct_ratio from c left join s using (lang)""")
def coverage(spark, sf_dir):
    train, val = halves(spark, sf_dir)
    return profile.coverage(val, replace.dictionary(train))


@query("q28_dataset_overall", f"""with {_DS}, o as (select count(*) as num_languages, cast(sum(num_samples) as bigint) as num_samples, cast(sum(total_tokens) as bigint) as total_tokens, cast(sum(changed_tokens) as bigint) as changed_tokens,
  cast(sum(empty_norm_tokens) as bigint) as empty_norm_tokens, cast(sum(norm_contains_space_tokens) as bigint) as norm_contains_space_tokens, max(max_sentence_len) as max_sentence_len,
  sum(avg_sentence_len * num_samples) as w, {sql.mean('changed_ratio')} as macro_changed_ratio, {sql.mean('lai_accuracy')} as macro_lai_accuracy from dsr)
select * exclude (w), round(w / num_samples, 6) as avg_sentence_len, round(changed_tokens * 1.0::double / total_tokens, 6) as changed_ratio, round(1 - changed_tokens * 1.0::double / total_tokens, 6) as lai_accuracy,
  round(empty_norm_tokens * 1.0::double / total_tokens, 6) as empty_norm_ratio, round(norm_contains_space_tokens * 1.0::double / total_tokens, 6) as norm_contains_space_ratio from o""")
def dataset_overall(spark, sf_dir):
    return profile.overall(profile.by_language(corpus(spark, sf_dir)))


_VIEW_ROWS = ", ".join(f"('{v}', '{lang}')" for v, langs in evaluate.VIEWS.items() for lang in langs)


@query("q29_eval_views", f"""with {sql.MFR}, {sql.VAL}, vw as (select 'all' as eval_group, * from val union all select g.eval_group, val.* from val join (values {_VIEW_ROWS}) g(eval_group, lang) using (lang)),
counted as (select eval_group, coalesce(lang, '__overall__') as lang, {sql.counts()} from vw group by grouping sets ((eval_group, lang), (eval_group)))
select eval_group, lang, {sql.COUNT_NAMES}, {sql.METRICS} from {sql.WITH_PR}""".replace("select g.eval_group, val.*", "select g.eval_group, val.*"))
def eval_views(spark, sf_dir):
    return evaluate.by_language(evaluate.with_views(mfr_scored(spark, sf_dir)), "eval_group")


#: The grid of the sweep (fixed values).
GRID_CONF = [round(0.50 + 0.05 * i, 2) for i in range(11)]


def token_kinds(rows: DataFrame, full: bool) -> DataFrame:
    """What configurations can tell apart, with the number ``w`` of tokens of each kind."""
    fixed = rows.withColumn("fix", F.when((noise() >= 0.5) & ~F.col("protected") & ((F.col("row_id") + F.col("tok_idx")) % 3 == 0), F.col("norm")))
    after = F.coalesce(F.nullif("mfr_pred", "raw"), F.nullif("fix", "raw"), F.col("raw")) if full else F.col("raw")
    fell = fixed.withColumn("fall", after)
    state = lambda c: F.when(F.col(c).isNull(), None).when(F.col(c) == F.col("raw"), "same").when(F.col(c) == F.col("norm"), "right").otherwise("wrong")
    names = ["tri_norm", "biL_norm", "biR_norm", "fall"]
    conf = [F.col(f"{level}_conf") for level in ngram.LEVELS]
    kinds = fell.select(
        "lang", "protected", (F.col("raw") != F.col("norm")).alias("needs"), *conf, (F.col("biL_total") >= F.col("biR_total")).alias("left_wins"), *[state(c).alias(f"{c}_state") for c in names]
    )
    return kinds.groupBy(*kinds.columns).agg(F.count("*").alias("w"))


def sweep(spark, sf_dir, full: bool) -> DataFrame:
    """Counts of each configuration, language and mode.

    Tokens that every configuration treats alike are counted first, so the grid
    multiplies those few kinds and not the tokens.
    """
    counted = predicted(spark, sf_dir, lambda told: token_kinds(told, full), keep=True)
    kinds = added(counted, *counted.columns[:-1])
    grid = spark.createDataFrame([(v, c, p) for v in ngram.VARIANTS for c in GRID_CONF for p in (False, True)], "variant string, conf_min double, protect boolean")
    every = kinds.crossJoin(F.broadcast(grid)).withColumn("biL_total", F.when(F.col("left_wins"), 1).otherwise(0)).withColumn("biR_total", F.when(F.col("left_wins"), 0).otherwise(1))
    by = ngram.source(F.col("variant"), F.col("conf_min"), F.col("protect"))
    told = F.when(by == "tri", F.col("tri_norm_state")).when(by == "biL", F.col("biL_norm_state")).when(by == "biR", F.col("biR_norm_state")).otherwise("same")
    final = F.when(told == "same", F.col("fall_state")).otherwise(told)
    scored = every.withColumn("final", final)
    right = (F.col("final") == "right") | ((F.col("final") == "same") & ~F.col("needs"))
    return scored.groupBy("variant", "conf_min", "protect", "lang").agg(*evaluate.confusion_of(F.col("needs"), F.col("final") != "same", right, F.col("w")))


def sweep_result(counted: DataFrame) -> DataFrame:
    keys = ["variant", "conf_min", "protect"]
    total = counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    by_lang = counted.groupBy(*keys).agg(mean_of_rounded(ratio(F.col("tp") - F.col("fp"), F.col("tp") + F.col("fn"))).alias("macro_err_all"))
    halves_ = counted.withColumn("g", F.col("lang").isin("de", "en")).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("g") == g, F.col(c)).otherwise(0)).alias(f"{c}_{n}") for g, n in ((False, "a"), (True, "b")) for c in ("tp", "fp", "fn")]
    )
    err = lambda s: ratio(F.col(f"tp{s}") - F.col(f"fp{s}"), F.col(f"tp{s}") + F.col(f"fn{s}"))
    made = total.join(by_lang, keys).join(halves_, keys)
    return made.select(
        *keys, "tp", "fp", "fn", err("").alias("err_all"), "macro_err_all", err("_a").alias("err_a"), err("_b").alias("err_b"), (F.round((F.round(err("_a") * 1e6, 0) + F.round(err("_b") * 1e6, 0)) / 2, 0) / 1e6).alias("err_weighted")
    )


def _sweep_sql(full: bool) -> str:
    values = ", ".join(f"('{v}', {c}::double, {str(p).lower()})" for v in ngram.VARIANTS for c in GRID_CONF for p in (False, True))
    after = (
        "coalesce(nullif(mfr_pred, raw), nullif(case when noisy and not prot and (row_id + tok_idx) % 3 = 0 then norm end, raw), raw)" if full else "raw"
    )
    e = lambda s: f"round({sql.div(f'tp{s} - fp{s}', f'(tp{s} + fn{s})')}, 6)"
    one = e("")
    return f"""with {_CASCADE},
kinds as (select lang, prot, raw, norm, tri_norm, tri_conf, bil_norm, bil_conf, bir_norm, bir_conf, bil_total, bir_total, {after} as fall, count(*) as w from casc group by all),
every as (select *, {sql.source("variant", "conf_min", "(protect and prot)")} as source from kinds, (values {values}) g(variant, conf_min, protect)),
told as (select *, coalesce(nullif({sql.CHOSEN}, raw), fall) as pred from every),
counted as (select variant, conf_min, protect, lang, {sql.counts(weight="w")} from told group by all),
t as (select variant, conf_min, protect, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn,
  {sql.mean(one)} as macro_err_all,
  {', '.join(f"coalesce(sum({c}) filter (where lang {op} ('de', 'en')), 0) as {c}{s}" for op, s in (("not in", "_a"), ("in", "_b")) for c in ("tp", "fp", "fn"))}
  from counted group by all)
select variant, conf_min, protect, tp, fp, fn, {e("")} as err_all, macro_err_all, {e("_a")} as err_a, {e("_b")} as err_b, round((round({e("_a")} * 1e6) + round({e("_b")} * 1e6)) / 2, 0) / 1e6 as err_weighted from t"""


@query("q30_sweep_tri_only", _sweep_sql(False))
def sweep_tri_only(spark, sf_dir):
    return sweep_result(sweep(spark, sf_dir, False))


@query("q31_sweep_full", _sweep_sql(True))
def sweep_full(spark, sf_dir):
    return sweep_result(sweep(spark, sf_dir, True))


def kept_predictions(spark, sf_dir) -> DataFrame:
    """Validation tokens with ``base_pred`` and ``hard``, written once: logs are laid over them later. What is like the raw form isn't written twice."""
    same = lambda c: F.nullif(c, "raw").alias(c)
    kept = predicted(spark, sf_dir, lambda told: mined(told).select("row_id", "tok_idx", "lang", "raw", same("norm"), same("base_pred"), "hard"), keep=True)
    return kept.withColumns({c: F.coalesce(c, "raw") for c in ("norm", "base_pred")})


def entered(spark, sf_dir: str, rows: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may have an entry in the log, and the others. A filter tells them apart where they are many; else all are among the first."""
    size = bytes_of(spark, sf_dir)
    if size <= PART_FROM:
        return rows, rows.limit(0)
    touched = telling.tokens_of(spark, log, size).hold("token")
    return rows.where(touched), rows.where(~touched)


def laid_over(touched: DataFrame, others: DataFrame, log: DataFrame, policy: str = "changes") -> DataFrame:
    """``cascade.overlay`` of rows that may have entries, and the others as they are."""
    return cascade.overlay(touched, log, policy).unionByName(others.withColumn("pred", F.col("base_pred")), allowMissingColumns=True)


def correction_log(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens with ``base_pred`` and ``hard``, the hard cases, and a stand-in log: some hard cases, some twice, some failed, some of no hard case."""
    spot = (F.col("row_id") + F.col("tok_idx")) % 3
    some = rows.where((F.col("hard") & (spot == 0)) | (~F.col("hard") & ((F.col("row_id") + F.col("tok_idx")) % 97 == 0)))
    entries = F.array(
        F.struct(F.lit(0).alias("s"), F.when(F.col("tok_idx") % 5 == 0, None).otherwise(F.col("norm")).alias("normalized")),
        F.struct(F.lit(1).alias("s"), F.when(F.col("tok_idx") % 4 == 0, F.col("raw")).when(F.col("tok_idx") % 7 == 0, F.lit("")).alias("normalized")),
    )
    log = some.select("row_id", "tok_idx", F.col("raw").alias("token"), F.explode(F.slice(entries, F.lit(1), F.when(F.col("tok_idx") % 2 == 0, 2).otherwise(1))).alias("e"))
    log = log.select("row_id", "tok_idx", "token", (tokens.position() * 2 + F.col("e.s")).alias("seq"), "e.normalized")
    return rows, rows.where("hard"), log


_LOG = f"""{_CASCADE}, rows_ as (select *, noisy and not prot and base_pred = raw as hard from casc),
picked as (select * from rows_ where (hard and (row_id + tok_idx) % 3 = 0) or (not hard and (row_id + tok_idx) % 97 = 0)),
log as (select row_id, tok_idx, raw as token, 0 as s, case when tok_idx % 5 = 0 then null else norm end as normalized from picked
  union all select row_id, tok_idx, raw, 1, case when tok_idx % 4 = 0 then raw when tok_idx % 7 = 0 then '' end from picked where tok_idx % 2 = 0),
ch as (select row_id, tok_idx, normalized as fix from (select *, row_number() over (partition by row_id, tok_idx order by s desc) as k from log where normalized is not null and normalized <> token) where k = 1),
la as (select row_id, tok_idx, normalized as fix from (select *, row_number() over (partition by row_id, tok_idx order by s desc) as k from log where normalized is not null) where k = 1)"""


@query("q32_submission_summary", f"with {_LOG} select lang, count(*) as tokens, count(distinct row_id) as sentences, count(*) filter (where base_pred <> raw) as changed_before, count(*) filter (where case when ch.fix is not null and ch.fix <> raw and hard then ch.fix else base_pred end <> raw) as changed_after from rows_ left join ch using (row_id, tok_idx) group by lang")
def submission_summary(spark, sf_dir):
    kept = kept_predictions(spark, sf_dir)

    def made(part):
        rows, _, log = correction_log(part(kept))
        touched, others = entered(spark, sf_dir, rows, log)
        mine = log.join(touched.where("hard").select("row_id", "tok_idx"), ["row_id", "tok_idx"], "left_semi")
        return laid_over(touched, others, mine).groupBy("lang").agg(
            F.count("*").alias("tokens"), F.count_distinct("row_id").alias("sentences"),
            F.count_if(F.col("base_pred") != F.col("raw")).alias("changed_before"), F.count_if(F.col("pred") != F.col("raw")).alias("changed_after"),
        )

    return added(by_sentences(spark, sf_dir, made), "lang")


_CP = f"""{sql.TOK}, cp0 as (select lang, raw, norm, count(*) as count from tok group by all),
cp1 as (select *, cast(sum(count) over (partition by lang, raw) as bigint) as raw_total, cast(sum(case when raw <> norm then count else 0 end) over (partition by lang, raw) as bigint) as changed_total from cp0),
cp as (select *, round(count * 1.0::double / changed_total, 6) as changed_confidence, round(count * 1.0::double / raw_total, 6) as raw_confidence from cp1 where raw <> norm),
cl as (select *, count >= 2 and changed_confidence >= 0.85 and raw_confidence >= 0.5 as high, count >= 1 and changed_confidence >= 0.75 and raw_confidence >= 0.3 as balanced from (
  select *, count(*) over (partition by lang, raw) as n_norms, row_number() over (partition by lang, raw order by count desc, norm) as k from cp) where k = 1)"""


@query("q33_dict_high_confidence", f"with {_CP} select lang, raw, norm, count, raw_total, changed_total, changed_confidence, raw_confidence from cl where high and not {sql.strong()}")
def dict_high(spark, sf_dir):
    rows = profile.classes(token_rows(spark, sf_dir)).where("high").where(~strong_protect(F.col("raw")))
    return rows.drop("n_norms", "high", "balanced", "class")


@query("q34_dict_classes", f"with {_CP} select lang, case when high then 'high' when balanced then 'balanced' when n_norms > 1 then 'ambiguous' else 'review' end as class, count(*) as entries, cast(sum(count) as bigint) as tokens from cl group by all")
def dict_classes(spark, sf_dir):
    return profile.classes(token_rows(spark, sf_dir)).groupBy("lang", "class").agg(F.count("*").alias("entries"), F.sum("count").alias("tokens"))


_PLAIN = "translate(lower({}), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc')"
_BARE = r"regexp_replace({}, '[.,;:!?\-]', '', 'g')"
_PATTERN = rf"""case when norm = '' then 'empty_norm_alignment' when lower(raw) = lower(norm) then 'case_change'
  when regexp_replace(raw, '\s', '', 'g') = regexp_replace(norm, '\s', '', 'g') then 'whitespace_change' when {_PLAIN.format("raw")} = {_PLAIN.format("norm")} then 'accent_or_diacritic_restore'
  when replace(replace(raw, '''', ''), '’', '') = replace(replace(norm, '''', ''), '’', '') then 'apostrophe_or_contraction_change' when {_BARE.format("raw")} = {_BARE.format("norm")} then 'punctuation_change'
  when regexp_matches(raw, '[0-9]') then 'digit_related_change' when length(norm) > length(raw) + 2 then 'expansion_or_abbreviation_restore'
  when length(norm) < length(raw) then 'shortening_or_deletion' else 'other_substitution' end"""


@query("q35_top_changed_pairs", f"with {_CP} select lang, raw, norm, count, raw_total, changed_confidence, raw_confidence, rank, {_PATTERN} as pattern from (select *, cast(row_number() over (partition by lang order by count desc, raw, norm) as integer) as rank from cp) where rank <= 300")
def top_changed_pairs(spark, sf_dir):
    return profile.top_pairs(token_rows(spark, sf_dir))


@query("q36_pattern_taxonomy", f"with {_CP} select lang, {_PATTERN} as pattern, count(*) as pairs, cast(sum(count) as bigint) as tokens from cp group by all")
def pattern_taxonomy(spark, sf_dir):
    return profile.changed_pairs(token_rows(spark, sf_dir)).withColumn("pattern", profile.pattern()).groupBy("lang", "pattern").agg(F.count("*").alias("pairs"), F.sum("count").alias("tokens"))


def dictionary_entries(train: DataFrame, mode: str) -> DataFrame:
    """Entries of a mode, ``pair_norm`` and ``context_sensitive``; ambiguous forms are context-sensitive."""
    made = profile.classes(train)
    use = F.col("high") if mode == "conservative" else F.col("balanced")
    return made.select("lang", "raw", F.when(use, F.col("norm")).alias("pair_norm"), (F.col("n_norms") > 1).alias("context_sensitive"))


_APPLY_CP = _CP.replace("from tok group by all)", "from tok where not val group by all)", 1)


@query("q37_dict_apply", f"with {_APPLY_CP}, v as (select tok.lang, tok.raw, tok.norm, cl.norm as cn, high, balanced, n_norms > 1 as cs, {sql.strong('tok.raw')} as prot from tok left join cl using (lang, raw) where val) " + " union all ".join(
    f"select '{mode}' as mode, {str(keep).lower()} as keep_context, lang, count(*) filter (where p <> raw) as changed, count(*) filter (where p = norm) as correct from (select *, case when {col} and not prot{' and not cs' if keep else ''} then cn else raw end as p from v) group by lang"
    for mode, col in (("conservative", "high"), ("balanced", "balanced")) for keep in (False, True)))
def dict_apply(spark, sf_dir):
    train, val = halves(spark, sf_dir)
    rows = ngram.with_protection(val)
    out = []
    for mode in ("conservative", "balanced"):
        for keep in (False, True):
            made = profile.apply_dictionary(rows, dictionary_entries(train, mode), F.col("protected"), keep)
            counted = made.groupBy("lang").agg(F.count_if(F.col("pred") != F.col("raw")).alias("changed"), F.count_if(F.col("pred") == F.col("norm")).alias("correct"))
            out.append(counted.select(F.lit(mode).alias("mode"), F.lit(keep).alias("keep_context"), "lang", "changed", "correct"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _words(name: str) -> str:
    r = candidates.RULES[name]
    return sql.listed(dict.fromkeys(r.words.split() + r.short.split()))


@query("q40_candidates_lexicon", f"with {sql.TOK} select lang, raw, count(*) as c from tok where ((lang = 'en' and lower(raw) in {_words('en')} and (not {sql.strong()} or raw in ('2', '4'))) or (lang in ('de', 'es') and not {sql.strong()} and ((lang = 'de' and lower(raw) in {_words('de')}) or (lang = 'es' and lower(raw) in {_words('es')})))) group by all")
def candidates_lexicon(spark, sf_dir):
    listed = F.lit(False)
    for name in ("de", "en", "es"):
        r = candidates.RULES[name]
        listed = listed | ((F.col("lang") == name) & F.lower("raw").isin(r.words.split() + r.short.split()))
    return _candidates(spark, sf_dir).where(listed)


def _candidates(spark, sf_dir) -> DataFrame:
    """Each distinct form is tested once: the test reads the count too, so that it isn't moved below the aggregation."""
    forms = token_rows(spark, sf_dir).groupBy("lang", "raw").agg(F.count("*").alias("c")).withColumn("code", lang_code(F.col("lang")))
    return forms.where(F.when(F.col("c") > 0, candidates.is_candidate(lang="code"))).drop("code")


@query("q40b_candidates")
def candidates_all(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query("q41_reduce_and_expand")
def reduce_and_expand(spark, sf_dir):
    forms = token_rows(spark, sf_dir).select("raw").distinct()
    worn = forms.select("raw", reduce_runs(F.col("raw")).alias("reduced"), expand_repetition(F.concat(F.regexp_replace("raw", "[^A-Za-z]", ""), F.lit("2nya"))).alias("expanded"))
    return worn.where("reduced <> raw or expanded is not null")


def case_sentences(spark, sf_dir) -> DataFrame:
    """The sentences that can have cases."""
    return corpus(spark, sf_dir).where("val").select("row_id", "raw")


@query("q43_prompt_lengths")
def prompt_lengths(spark, sf_dir):
    """Length and digest of each hard case's prompt."""
    hard = cases(spark, sf_dir, lambda hard: hard.select("row_id", "tok_idx", "lang", "token", "mfr_top5"), keep=True)

    def made(part):
        told = prompts.with_prompt(part(hard), part(case_sentences(spark, sf_dir)), F.nullif("mfr_top5", F.lit("")))
        # Parts are written, so digests as bytes.
        return told.select("row_id", "tok_idx", F.length("prompt").alias("n_chars"), F.unhex(F.md5(F.col("prompt").cast("binary"))).alias("digest"))

    return by_sentences(spark, sf_dir, made).withColumn("digest", F.lower(F.hex("digest")))


@query("q42_span_candidates", rf"with {sql.TOK} select lang, raw as first, next as second, count(*) as c from tok where next <> '<EOS>' and regexp_matches(lower(raw), '^(?:l|d|j|m|t|s|c|n|qu|un|dell|all|nell)[''’]?$') and regexp_matches(next, '^[A-Za-zÀ-ÿ]') group by all")
def span_candidates(spark, sf_dir):
    rows = token_rows(spark, sf_dir).where("next <> '<EOS>'")
    clitic = F.lower("raw").rlike(r"^(?:l|d|j|m|t|s|c|n|qu|un|dell|all|nell)['’]?$")
    return rows.where(clitic & F.col("next").rlike("^[A-Za-zÀ-ÿ]")).groupBy("lang", F.col("raw").alias("first"), F.col("next").alias("second")).agg(F.count("*").alias("c"))


@query("q44_parse_json", """select event_id, case when json_valid(props) and json_type(props) = 'OBJECT' then true else false end as parsed,
  coalesce(len(json_keys(case when json_valid(props) and json_type(props) = 'OBJECT' then props end)), 0) as n_keys from events""")
def parse_json(spark, sf_dir):
    from ..operators.parse import whole_object

    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", whole_object(F.col("props")).isNotNull().alias("parsed"), F.coalesce(F.size(F.when(whole_object(F.col("props")).isNotNull(), keys)), F.lit(0)).cast("bigint").alias("n_keys"))


@query("q45_overlay_policies", f"with {_LOG} select 'changes' as policy, lang, count(*) filter (where p <> base_pred) as laid, count(*) filter (where p = norm) as correct from (select rows_.*, case when ch.fix is not null and ch.fix <> raw then ch.fix else base_pred end as p from rows_ left join ch using (row_id, tok_idx)) group by lang union all select 'latest', lang, count(*) filter (where p <> base_pred), count(*) filter (where p = norm) from (select rows_.*, case when la.fix is not null and la.fix <> raw then la.fix else base_pred end as p from rows_ left join la using (row_id, tok_idx)) group by lang")
def overlay_policies(spark, sf_dir):
    kept = kept_predictions(spark, sf_dir)

    def made(part):
        rows, _, log = correction_log(part(kept))
        touched, others = entered(spark, sf_dir, rows, log)
        laid = [
            laid_over(touched, others, log, p).groupBy("lang").agg(F.count_if(F.col("pred") != F.col("base_pred")).alias("laid"), F.count_if(F.col("pred") == F.col("norm")).alias("correct")).select(F.lit(p).alias("policy"), "lang", "laid", "correct")
            for p in ("changes", "latest")
        ]
        return laid[0].unionByName(laid[1])

    return added(by_sentences(spark, sf_dir, made), "policy", "lang")


@query("q46_resume", f"with {_LOG} select row_id, tok_idx, lang, raw as token from rows_ where hard and not exists (select 1 from log where log.row_id = rows_.row_id and log.tok_idx = rows_.tok_idx)")
def resume(spark, sf_dir):
    _, hard, log = correction_log(kept_predictions(spark, sf_dir))
    return cascade.todo(hard, log).select("row_id", "tok_idx", "lang", F.col("raw").alias("token"))


@query("q47_stale_corrections", f"with {_LOG} select count(*) as stale, count(distinct row_id) as sentences from log where not exists (select 1 from rows_ where hard and log.row_id = rows_.row_id and log.tok_idx = rows_.tok_idx)")
def stale_corrections(spark, sf_dir):
    _, hard, log = correction_log(kept_predictions(spark, sf_dir))
    return cascade.stale(hard, log).agg(F.count("*").alias("stale"), F.count_distinct("row_id").alias("sentences"))


def _fewshot(positive: bool):
    def run(spark, sf_dir):
        """Examples for every question of the benchmark's words: sentences are the documents' lines."""
        docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
        lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("k", "line")).where("trim(line) <> ''")
        named = lines.select((F.col("doc_id") * 100_000 + F.col("k")).alias("doc_id"), "lang", F.col("line").alias("text"))
        train = tokens.explode(tokens.derived_sentences(named).where("not val"))
        items = table(spark, sf_dir, "benchmark").where("item_id is not null and text is not null")
        words = items.select("item_id", "text", F.element_at(F.array_sort(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda a, b: F.length(b) - F.length(a)), 1).alias("form"))
        targets = words.where("form is not null").select(F.col("item_id").alias("target_id"), F.lit("en").alias("lang"), "form", "text")
        return fewshot.retrieve(targets, fewshot.pool(train, positive), named.select(F.col("doc_id").alias("row_id"), "text"))

    return run


query("q38_fewshot_positive")(_fewshot(True))
query("q39_fewshot_negative")(_fewshot(False))


@query("q48_pairs_and_hints", f"""with {_APPLY_CP}, e as (select lang, raw, norm as cn, high and n_norms = 1 as sure,
  case when high then 'high_confidence_context_sensitive' when balanced then 'context_sensitive_pairs' when n_norms > 1 then 'ambiguous_pairs' else 'review_pairs' end as src from cl),
v as (select tok.lang, tok.raw, tok.norm, case when sure and not {sql.strong('tok.raw')} then cn else tok.raw end as p, case when not sure then src end as hint_source from tok left join e using (lang, raw) where val)
select lang, hint_source, count(*) as tokens, count(*) filter (where p <> raw) as changed, count(*) filter (where p = norm) as correct from v group by all""")
def pairs_and_hints(spark, sf_dir):
    train, val = halves(spark, sf_dir)
    section = F.when(F.col("class") == "balanced", "context").otherwise(F.col("class"))
    entries = profile.classes(train).select("lang", "raw", "norm", "count", "raw_total", section.alias("section"), (F.col("n_norms") > 1).alias("flagged"))
    made = hints.apply_pairs(ngram.with_protection(val), hints.pairs(entries), F.col("protected"))
    shown = made.join(hints.hints(entries), ["lang", "raw"], "left").withColumn("hint_source", F.get("hints", F.lit(0)).source)
    return shown.groupBy("lang", "hint_source").agg(
        F.count("*").alias("tokens"), F.count_if(F.col("changed")).alias("changed"), F.count_if(F.col("pred") == F.col("norm")).alias("correct")
    )


@query("q49_training_labels", f"""with {sql.TOK}, n as (select lang, count(*) as rows_, cast(sum(2 * len(toks) + 2) as bigint) as pieces, cast(sum(len(toks) + 2) as bigint) as ignored from sent group by lang),
c as (select lang, count(*) filter (where raw <> norm) as ones from tok group by lang)
select n.*, coalesce(ones, 0) as ones from n left join c on n.lang is not distinct from c.lang""")
def training_labels(spark, sf_dir):
    none = F.array(F.lit(None).cast("int"))
    twice = F.flatten(F.transform("raw", lambda _, i: F.array(i, i)))  # a stand-in tokenizer: two pieces a word, one before and after the sentence
    rows = corpus(spark, sf_dir).select("lang", labels.changed_labels().alias("labels"), F.concat(none, twice, none).alias("word_ids"))
    made = rows.select("lang", labels.piece_labels().alias("p"))
    held = lambda value: F.sum(F.size(F.filter("p", lambda x: x == value)))
    return made.groupBy("lang").agg(F.count("*").alias("rows_"), F.sum(F.size("p")).alias("pieces"), held(labels.IGNORED).alias("ignored"), held(1).alias("ones"))


@query("q50_report_rows", f"{_EVAL} select 'documents' as dataset_name, 'mfr' as model_name, *, detection_precision as precision, detection_recall as recall, detection_f1 as f1 from scored where lang <> '__overall__'")
def report_rows(spark, sf_dir):
    measured = evaluate.with_short_names(evaluate.by_language(mfr_scored(spark, sf_dir)))
    return evaluate.language_rows(measured, "documents", "mfr")
