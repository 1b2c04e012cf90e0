"""Token predicates and normal forms as Spark columns.

Java's character classes are ASCII unless told otherwise, so every pattern
carries ``(?U)``; full matches end in ``\\z``, since ``$`` also matches before
a final newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as protected.
PROTECTED_PUNCT = [
    "_", ".", ",", ":", ";", "!", "?", "(", ")", "[", "]", "{", "}", "-", "—", "–", "…", "...", "..", "....",
    '"', "'", "’", "‘", "“", "”", "~", "〜", "・", "|", "/", "\\", "*", "+", "=", "<", ">",
]
SOCIAL_MARKERS = ["RT", "QT", "MT"]
PLACEHOLDERS = ["[url]", "[URL]", "<url>", "<URL>", "@username", "@mention"]
URL = r"(?i)^(?:https?://|www\.)"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
NUMBER = r"(?i)^(?:(?:[$€£₩¥])?\d+(?:[.,:/\-]\d+)*(?:%|[a-zA-Z]{0,4})?|\d+(?:st|nd|rd|th)|\d+\s?(?:am|pm))$"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}]"
EMOTICON = r"^(?:[:;=xX8][-o*']?[)D(Pp/\\]|[<]?3|T_T|t_t|ㅠㅠ+|ㅜㅜ+|[xX]D+|-_-+|\^_?\^+)$"
JA_PUNCT = ["...", "…", "〜", "～", "。", "、", "！", "？", "!", "?", "・", "･", "ー", "（", "）", "(", ")", "「", "」", "『", "』"]
#: Three letters and more that no rule of protection can match: no digit, no mark, and no emoticon, as those of letters begin with x.
PLAIN_WORD = r"^[A-WYZa-wyzÀ-ÿ][A-Za-zÀ-ÿ]{2,}\z"
LANG_ALIASES = {"id-en": "iden", "id_en": "iden", "tr-de": "trde", "tr_de": "trde"}
LANGUAGES = "da de en es hr id iden it ja ko nl sl sr th tr trde vi".split()
BOS, EOS = "<BOS>", "<EOS>"


def rx(pattern: str) -> str:
    return "(?U)" + pattern


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, rx(r"^\s+|\s+\z"), "")


def lang_code(c: Column) -> Column:
    """A language code in its usual form: lower case, aliases resolved; null gives an empty one."""
    low = strip(F.lower(F.coalesce(c, F.lit(""))))
    out = low
    for alias, code in LANG_ALIASES.items():
        out = F.when(low == alias, code).otherwise(out)
    return out


def strong_protect(c: Column, extra: list[str] | None = None) -> Column:
    """Tokens that stay as they are: empty ones, punctuation, addresses, numbers, codes, tags, emoji, emoticons.

    Plain words are told by one pattern, so that the others are rarely asked.
    """
    s = strip(F.coalesce(c, F.lit("")))
    single = "".join("\\" + p for p in PROTECTED_PUNCT if len(p) == 1)
    rules = [
        s == "",
        s.isin(PROTECTED_PUNCT + SOCIAL_MARKERS + PLACEHOLDERS),
        s.rlike(rx(r"^[#@]\S")),
        s.rlike(rx(URL)),
        s.rlike(rx(EMAIL)),
        s.rlike(rx(NUMBER)),
        s.rlike("[A-Za-z]") & s.rlike(rx(r"\d")),
        s.contains("#") | s.contains("@"),
        s.rlike(f"^[{single}]+$"),
        s.rlike(EMOJI),
        s.rlike(EMOTICON),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    out = ~F.coalesce(c.rlike(PLAIN_WORD), F.lit(False)) & out
    return out | s.isin(extra) if extra else out


def weak_protect(c: Column) -> Column:
    """The lighter rule: tags, addresses, symbols alone, any digit."""
    s = F.coalesce(c, F.lit(""))
    return (
        s.startswith("@") | s.startswith("#") | F.lower(s).contains("http") | F.lower(s).contains("www.")
        | s.rlike(rx(r"^[\W_]+\z")) | s.rlike(rx(r"\d"))
    )


def reduce_runs(c: Column, least: int = 3, keep: int = 2, letters: str = "A-Za-z") -> Column:
    """Runs of ``least`` or more of one letter, cut to ``keep``."""
    return F.regexp_replace(c, rf"([{letters}])\1{{{least - 1},}}", "$1" * keep)


# Beginnings after which a mark isn't read as a repetition.
NO_REPETITION = ["ber", "ter", "mem", "men", "meng", "pem", "pen"]


def expand_repetition(c: Column) -> Column:
    """``anak2nya`` to ``anak-anaknya``; null where it isn't a repetition or has an affix in front."""
    shape = r"^([A-Za-z]{3,})(?:2|['\"]{1,2})([A-Za-z]*)\z"
    base, rest = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    affixed = F.lower(base).rlike(f"^(?:{'|'.join(NO_REPETITION)})")
    return F.when(c.rlike(shape) & ~affixed, F.concat(base, F.lit("-"), base, rest))


def mention_mark(c: Column) -> Column:
    return F.when(c.startswith("@") & (F.length(c) > 1), F.lit("[mention]")).otherwise(c)


def thai_repeat_space(c: Column) -> Column:
    """A space before a final repetition mark."""
    return F.regexp_replace(c, r"^(\S+?)ๆ$", "$1 ๆ")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """A quotient rounded to six digits; 0 where nothing is divided by."""
    return F.round(safe_div(a, b), 6)


def mean_of_rounded(c: Column) -> Column:
    """Mean of values of six digits, rounded to six digits; summed as whole numbers, so the order of rows doesn't matter."""
    return F.round(F.sum(F.round(c * 1e6, 0).cast("bigint")) / F.count(c), 0) / 1e6
