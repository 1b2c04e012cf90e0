"""Secret scan with multipart credential linking.

Three base patterns find secrets that are evident alone. Access identifiers,
values that might be secrets and endpoints are weak alone: they are reported
only where complementary parts lie in one scope. A scope is a run of
characters around an access identifier, cut at blank lines; a part is in it if
all of the part is. Scopes' starts and ends both grow along the text, so the
interval join is a binary search a part: of the scopes that start at or before
the part, the last reaches farthest.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import bound_batches, map_arrow, table, text_or_empty

ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts: an identifier's, a secret value's and an endpoint's form.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIza|ghp_|sk_live_|pk_live_|xox[bp]-)[A-Za-z0-9_-]{12,}")
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{32,128}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+(?:amazonaws\.com|googleapis\.com|windows\.net|internal)(?![A-Za-z0-9-])")
#: Kinds in their order; the last three are reported only when linked.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
#: A scope reaches so many code points to either side of its identifier.
REACH = 300
BLANK = re.compile(r"\n[ \t\r]*\n")
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def link_parts(text: str, base: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak parts that are in one scope with a complementary part.

    An identifier counts if its scope holds a secret; a secret value if some
    identifier's scope holds it; an endpoint if a scope holds it and a secret.
    Base secrets are complementary parts too and aren't reported again.
    """
    ids = [m.span() for m in IDENTIFIER.finditer(text)]
    if not ids:
        return []
    strong = {(s, e) for s, kind, e in base if kind != 1}
    values = sorted({m.span() for m in VALUE.finditer(text)} | strong)
    values = [v for v in values if not _overlaps(ids, v)]
    blanks = [m.start() for m in BLANK.finditer(text)]
    scopes = []
    for s, e in ids:
        k = bisect_right(blanks, s)
        scopes.append((max(s - reach, blanks[k - 1] if k else 0), min(e + reach, blanks[k] if k < len(blanks) else len(text))))
    found = [(s, 4, e) for s, e in values if (s, e) not in strong and _inside(scopes, s, e)]
    # The earliest end of the values from each on: a scope holds a secret if the earliest from its start on ends in it.
    starts, earliest = [v[0] for v in values], [len(text) + 1] * (len(values) + 1)
    for k in range(len(values) - 1, -1, -1):
        earliest[k] = min(values[k][1], earliest[k + 1])
    whole = [k for k, (low, high) in enumerate(scopes) if earliest[bisect_left(starts, low)] <= high]
    found += [(ids[k][0], 3, ids[k][1]) for k in whole]
    held = [scopes[k] for k in whole]
    return found + [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text) if _inside(held, *m.span())]


def _inside(scopes: list[tuple[int, int]], start: int, end: int) -> bool:
    """If one of the scopes, whose starts and ends both grow, holds [start, end)."""
    k = bisect_right(scopes, start, key=lambda x: x[0])
    return k > 0 and scopes[k - 1][1] >= end


def _overlaps(ids: list[tuple[int, int]], v: tuple[int, int]) -> bool:
    k = bisect_left(ids, v)
    return any(v[0] < e and s < v[1] for s, e in ids[max(0, k - 1) : k + 1])


def scan_text(text: str, reach: int = REACH) -> tuple[list, list]:
    """The base spans and all spans, each (start, kind, end) in order."""
    base = sorted(base_spans(text))
    return base, sorted(base + link_parts(text, base, reach))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at or not out:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Spans of each text: ``doc_id, n_assign, n_access, n_hex, base, spans``, a row for each row of the input.

    ``base`` and ``spans`` are ``kind:start:end`` in code points, by start and
    then by kind. A null or empty text has none; null ids stay null; repeated
    rows stay; an empty table gives no rows. One pass, no shuffle.
    """

    def start():
        def step(columns):
            ids, texts = columns
            rows = [scan_text(t, reach) for t in texts]
            count = lambda kind: [sum(x[1] == kind for x in base) for base, _ in rows]
            return [ids, count(0), count(1), count(2), [joined(b) for b, _ in rows], [joined(s) for _, s in rows]]

        return step

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"
    return map_arrow(df, [F.col(id_col).cast("bigint"), text_or_empty(text_col)], schema, start)


def redact(df: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``df`` with every span of ``text_col`` masked. Nulls stay null, and all rows and columns stay."""
    @pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else mask_text(t, scan_text(t, reach)[1]))

    bound_batches(df.sparkSession)
    return df.withColumn(text_col, masked(F.col(text_col)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def query(spark, sf_dir):
    """Secrets in every document."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
