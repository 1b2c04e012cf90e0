"""Common table expressions of the SQL forms: derived sentences, tokens and statistics, as DuckDB reads them."""

from __future__ import annotations

from ..functions.text import PROTECTED_PUNCT, SOCIAL_MARKERS, PLACEHOLDERS


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(quote, values)) + ")"


SENT = r"""sent as (select doc_id as row_id, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as toks
  from documents where doc_id is not null and text is not null)"""
TOK = f"""{SENT},
tok0 as (select row_id, lang, len(toks) as n_tok, unnest(range(len(toks))) as tok_idx, unnest(toks) as norm from sent),
tok1 as (select *, case when (row_id * 31 + tok_idx) % 4 = 0 then translate(lower(norm), 'éèêàçôäöüßñáíóú', 'eeeacoaousnaiou') else norm end as raw,
  row_id % 5 = 0 as val from tok0),
tok as (select *, coalesce(lag(raw) over w, '<BOS>') as prev, coalesce(lead(raw) over w, '<EOS>') as next
  from tok1 window w as (partition by row_id order by tok_idx))"""
PAIRS = f"""{TOK},
pairs as (select lang, raw, norm, count(*) as c from tok where not val group by all)"""
MFR = f"""{PAIRS},
mfr as (select lang, raw, norm as top_norm, c as top_count, total from (
  select *, sum(c) over (partition by lang, raw) as total, row_number() over (partition by lang, raw order by c desc, norm) as k from pairs) where k = 1)"""
STATS = f"""{PAIRS},
ranked as (select *, sum(c) over (partition by lang, raw) as total, row_number() over (partition by lang, raw order by c desc, norm) as k from pairs),
stats as (select lang, raw, max(case when k = 1 then norm end) as top_norm, max(case when k = 1 then c end) as top_count, max(total) as total,
  max(case when k = 1 then c end) * 1.0::double / max(total) as confidence,
  (max(total) - sum(case when norm = raw then c else 0 end)) * 1.0::double / max(total) as change_rate,
  (max(case when k = 1 then c end) - coalesce(max(case when k = 2 then c end), 0)) * 1.0::double / max(total) as margin,
  -sum(c * 1.0::double / total * ln(c * 1.0::double / total)) as entropy,
  count(*) as n_cands, string_agg(norm || ':' || c, ',' order by c desc, norm) filter (where k <= 5) as top5,
  bool_or(norm <> raw) as other
  from ranked group by lang, raw)"""
VAL = "val as (select tok.*, coalesce(mfr.top_norm, tok.raw) as pred, mfr.top_norm from tok left join mfr using (lang, raw) where tok.val)"


def ngram(level: str, keys: str) -> str:
    return f"""{level}_c as (select {keys}, norm, count(*) as c, min(row_id * 10000000 + tok_idx) as first_pos from tok where not val group by all),
{level} as (select {keys}, norm, total, c * 1.0::double / total as conf from (
  select *, sum(c) over (partition by {keys}) as total, row_number() over (partition by {keys} order by c desc, first_pos, norm) as k from {level}_c) where k = 1)"""


NGRAM = f"""{TOK},
{ngram("tri", "lang, prev, raw, next")},
{ngram("bil", "lang, prev, raw")},
{ngram("bir", "lang, raw, next")}"""
JOINED = """joined as (select t.row_id, t.lang, t.tok_idx, t.raw, t.norm,
  a.norm as tri_norm, a.total as tri_total, a.conf as tri_conf, b.norm as bil_norm, b.total as bil_total, b.conf as bil_conf,
  c.norm as bir_norm, c.total as bir_total, c.conf as bir_conf
  from tok t left join tri a using (lang, prev, raw, next) left join bil b using (lang, prev, raw) left join bir c using (lang, raw, next) where t.val)"""


def source(variant: str, conf: str, protect: str = "false") -> str:
    """The deciding level; ``variant`` and ``conf`` are SQL expressions."""
    left = f"coalesce(bil_conf >= {conf}, false) and {variant} in ('tri_biL', 'tri_bi_both')"
    right = f"coalesce(bir_conf >= {conf}, false) and {variant} in ('tri_biR', 'tri_bi_both')"
    return f"""case when {protect} then 'protected' when coalesce(tri_conf >= {conf}, false) then 'tri'
  when {left} and {right} then case when bil_total >= bir_total then 'biL' else 'biR' end
  when {left} then 'biL' when {right} then 'biR' else 'none' end"""


CHOSEN = "case source when 'tri' then tri_norm when 'biL' then bil_norm when 'biR' then bir_norm else raw end"


def strong(c: str = "raw") -> str:
    s = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    single = "".join("\\" + p if p in r"\[]{}().^$*+?|/-" else ("''" if p == "'" else p) for p in PROTECTED_PUNCT if len(p) == 1)
    return rf"""({s} = '' or {s} in {listed(PROTECTED_PUNCT + SOCIAL_MARKERS + PLACEHOLDERS)}
  or regexp_matches({s}, '^[#@]\S') or regexp_matches({s}, '(?i)^(?:https?://|www\.)') or regexp_matches({s}, '^[^\s@]+@[^\s@]+\.[^\s@]+$')
  or regexp_matches({s}, '(?i)^(?:(?:[$€£₩¥])?\p{{Nd}}+(?:[.,:/\-]\p{{Nd}}+)*(?:%|[a-zA-Z]{{0,4}})?|\p{{Nd}}+(?:st|nd|rd|th)|\p{{Nd}}+\s?(?:am|pm))$')
  or (regexp_matches({s}, '[A-Za-z]') and regexp_matches({s}, '\p{{Nd}}')) or contains({s}, '#') or contains({s}, '@')
  or regexp_matches({s}, '^[{single}]+$') or regexp_matches({s}, '[\x{{1F300}}-\x{{1FAFF}}\x{{2700}}-\x{{27BF}}\x{{2600}}-\x{{26FF}}]')
  or regexp_matches({s}, '^(?:[:;=xX8][-o*'']?[)D(Pp/\\]|[<]?3|T_T|t_t|ㅠㅠ+|ㅜㅜ+|[xX]D+|-_-+|\^_?\^+)$'))"""


def weak(c: str = "raw") -> str:
    return rf"""(starts_with({c}, '@') or starts_with({c}, '#') or contains(lower({c}), 'http') or contains(lower({c}), 'www.')
  or regexp_matches({c}, '^[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}_]+$|^[_\p{{Pc}}\p{{P}}\p{{S}}]+$') or regexp_matches({c}, '\p{{Nd}}'))"""


def counts(where: str = "", raw: str = "raw", gold: str = "norm", pred: str = "pred", weight: str = "1") -> str:
    rules = {
        "total": "true",
        "correct": f"{pred} = {gold}",
        "lai_correct": f"{raw} = {gold}",
        "gold_changed": f"{raw} <> {gold}",
        "pred_changed": f"{raw} <> {pred}",
        "tp": f"{raw} <> {gold} and {pred} = {gold}",
        "fp": f"({raw} <> {gold} and {pred} <> {gold} and {raw} <> {pred}) or ({raw} = {gold} and {raw} <> {pred})",
        "fn": f"{raw} <> {gold} and {pred} <> {gold}",
        "tn": f"{raw} = {gold} and {raw} = {pred}",
    }
    return ", ".join(f"cast(sum(case when {rule} then {weight} else 0 end) as bigint) as {name}" for name, rule in rules.items())


def div(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0.0 else ({a})::double / ({b}) end"


METRICS = f"""round({div("correct", "total")}, 6) as accuracy, round({div("lai_correct", "total")}, 6) as lai_accuracy,
  round({div("tp - fp", "(tp + fn)")}, 6) as err, round(p, 6) as detection_precision, round(r, 6) as detection_recall,
  round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 6) as detection_f1,
  round({div("fp", "total")}, 6) as overnormalization_rate, round({div("fn", "total")}, 6) as undernormalization_rate"""
WITH_PR = f"(select *, {div('tp', '(tp + fp)')} as p, {div('tp', '(tp + fn)')} as r from counted)"
COUNT_NAMES = "total, correct, lai_correct, gold_changed, pred_changed, tp, fp, fn, tn"


def mean(c: str) -> str:
    return f"(round(sum(cast(round({c} * 1e6) as bigint))::double / count({c}), 0) / 1e6)"
