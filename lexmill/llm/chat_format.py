"""Preference formatting: pairs of a chosen and a rejected conversation.

The turns that both begin with are rendered once, as the prompt. What is left
of either is a completion, with the character ranges that bear loss: what the
assistant says and its closing mark, never roles or other parties' turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

#: A turn is OPEN role newline text CLOSE newline (fixed values).
OPEN, CLOSE = "<|turn|>", "<|end|>"
TURN = "struct<turn:bigint,role:string,text:string>"


def conversations(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation: its turns in order. Ties of a turn's number go by role, then text; exact repeats of a turn count once.

    A null role or text counts as empty; rows with a null id or turn are no turn of any conversation.
    """
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    named = df.where(F.col(id_col).isNotNull() & F.col("turn").isNotNull())
    return named.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit("\n"), t.text, F.lit(CLOSE), F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """Ranges start-end of a completion that bear loss, comma-joined; ends are exclusive."""
    head = len(OPEN) + 1

    def add(state, t):
        start = state.at + head + F.length(t.role)
        end = start + F.length(t.text) + len(CLOSE)
        return F.struct(
            (end + 1).cast("int").alias("at"),
            F.when(t.role == "assistant", F.array_append(state.spans, F.concat_ws("-", start, end))).otherwise(state.spans).alias("spans"),
        )

    begin = F.struct(F.lit(0).cast("int").alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))
    return F.array_join(F.aggregate(turns, begin, add).spans, ",")


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Prompt, completions and masks of each pair of turn arrays.

    Result: ``pair_id, n_common, prompt, chosen_text, chosen_mask,
    rejected_text, rejected_mask, informative``. Two turns are equal if role
    and text are, whatever their numbers. A null side counts as no turns; a
    pair without a difference or without a completion that bears loss on either
    side is kept and marked as not informative; an empty table gives no rows.
    Native expressions over one row: no shuffle.
    """
    a, b = (F.coalesce(F.col(c), F.expr(f"cast(array() as array<{TURN}>)")) for c in (chosen, rejected))
    narrow = pairs.select(F.col(id_col).alias("pair_id"), a.alias("a"), b.alias("b"))
    differs = F.filter(
        F.sequence(F.lit(0), F.least(F.size("a"), F.size("b"))),
        lambda i: F.coalesce(
            (F.get(F.col("a"), i).role != F.get(F.col("b"), i).role) | (F.get(F.col("a"), i).text != F.get(F.col("b"), i).text), F.lit(True)
        ),
    )
    cut = narrow.withColumn("n", F.array_min(differs))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c) - F.col("n"))
    out = cut.select(
        "pair_id",
        F.col("n").cast("bigint").alias("n_common"),
        _rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(rest("a")).alias("chosen_text"),
        _mask(rest("a")).alias("chosen_mask"),
        _rendered(rest("b")).alias("rejected_text"),
        _mask(rest("b")).alias("rejected_mask"),
    )
    return out.withColumn("informative", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != "") & (F.col("chosen_text") != F.col("rejected_text")))


def query(spark, sf_dir):
    """Every conversation, against itself with its last assistant turn replaced by the first one's text and nothing after it.

    The rejected side is shorter where turns follow the last assistant turn. A
    conversation without an assistant turn differs in nothing and isn't informative.
    """
    whole = conversations(table(spark, sf_dir, "conversations"))
    said = F.expr("filter(sequence(1, size(turns)), k -> turns[k - 1].role = 'assistant')")
    worse = F.expr(
        "case when size(said) = 0 then turns else concat(slice(turns, 1, array_max(said) - 1), array(named_struct("
        "'turn', turns[array_max(said) - 1].turn, 'role', 'assistant', 'text', turns[said[0] - 1].text))) end"
    )
    return format_pairs(whole.withColumn("said", said).select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), worse.alias("rejected")))


SQL = f"""
with t as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null
), l as (
  select *, max(p) over c as m, max(case when role = 'assistant' then p end) over c as la, min(case when role = 'assistant' then p end) over c as fa
  from (select *, row_number() over (partition by conv_id order by turn, role, text) as p from t) window c as (partition by conv_id)
), w as (
  select *, max(case when p = fa then text end) over c as said, max(case when p = la then text end) over c as last_said from l window c as (partition by conv_id)
), n as (
  select *, case when la is null then m when last_said = said then la else la - 1 end as n from w
), sides as (
  select conv_id, n, p, role, 'a' as side, text from n
  union all
  select conv_id, n, p, role, 'b', case when p = la then said else text end from n where p <= coalesce(la, m)
), r as (
  select *, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) as turn_text from sides
), o as (
  select *, coalesce(sum(length(turn_text)) over (partition by conv_id, side, p > n order by p rows between unbounded preceding and 1 preceding), 0) + {len(OPEN) + 1} + length(role) as pos from r
), g as (
  select conv_id, max(n) as n, coalesce(string_agg(turn_text, '' order by p) filter (where side = 'a' and p <= n), '') as prompt,
    coalesce(string_agg(turn_text, '' order by p) filter (where side = 'a' and p > n), '') as chosen_text,
    coalesce(string_agg(pos || '-' || (pos + length(text) + {len(CLOSE)}), ',' order by p) filter (where side = 'a' and p > n and role = 'assistant'), '') as chosen_mask,
    coalesce(string_agg(turn_text, '' order by p) filter (where side = 'b' and p > n), '') as rejected_text,
    coalesce(string_agg(pos || '-' || (pos + length(text) + {len(CLOSE)}), ',' order by p) filter (where side = 'b' and p > n and role = 'assistant'), '') as rejected_mask
  from o group by conv_id
)
select conv_id as pair_id, cast(n as bigint) as n_common, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask,
  chosen_mask <> '' and rejected_mask <> '' and chosen_text <> rejected_text as informative
from g
"""
