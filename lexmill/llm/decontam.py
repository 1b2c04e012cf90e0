"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words are numbered and put into one automaton over all items. A
document's words stream through it: at each word the automaton holds the
longest suffix of what was read that occurs in some item. Where that reaches a
window (eight words, or all of a shorter item), the window's words are hit and
the items that hold the window are found at the state's suffix-link ancestor of
that length.

Only words in runs of known word pairs can start or continue a match of two
words or more, so a vectorised test of pairs picks the runs and the automaton
reads those alone; it reads them whole, so nothing is lost.

The items are the small side. They are cut into blocks of bounded size (a long
item into pieces that overlap by a window less a word), each with an automaton
of its own; a block, as bytes, is what is broadcast. A task reads its texts once,
in bounded lots, and each lot against all blocks in turn with one automaton in
memory; hits of all blocks on the original text are merged before anything is
decided, so results don't depend on how items fall into blocks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import ascii_lower, bound_batches, table, text_or_empty

WINDOW = 8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a block of items at most: about 60 MB of automaton.
BLOCK_WORDS = 300_000
#: Characters of texts that a task holds while it reads them against several blocks.
LOT_CHARS = 16 << 20


@dataclass(frozen=True)
class Limits:
    """What leaves a document: spans of ``span_words`` hit words or more, or all of it from ``coverage`` on.

    Coverage counts every hit word, also those of items shorter than a span.
    """

    span_words: int = 8
    coverage: float = 0.5


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered, pairs, lengths = [], set(), set()
        for key, words in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
            if not seq:
                continue
            numbered.append((key, seq))
            pairs.update(zip(seq, seq[1:], strict=False))
            lengths.add(min(window, len(seq)))
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.lengths = sorted(lengths)
        self.size = max(1, len(self.ids))
        self.pairs = np.array(sorted(a * self.size + b for a, b in pairs), dtype=np.int64)
        self.holds: dict[tuple[int, int], set[int]] = {}
        for key, seq in numbered:
            n = min(window, len(seq))
            for state in self._states(seq, n):
                self.holds.setdefault((n, state), set()).add(key)
        self.at: list[dict[int, int]] = [{} for _ in self.next]  # state -> {window length: its state}
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            above = self.at[up]
            own = {n: state for n in self.lengths if self.length[up] < n <= self.length[state]}
            self.at[state] = above | own if own else above
        self.windows = [
            [(n, s) for n, s in found.items() if (n, s) in self.holds] for found in self.at
        ]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _states(self, seq: list[int], n: int) -> Iterator[int]:
        """The state of each window of n words of one of the items."""
        state, have = 0, 0
        for c in seq:
            state, have = self.next[state][c], have + 1
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            have = min(have, self.length[state])
            if have >= n:
                yield state

    def read(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit stretches [start, end) of a text's words, and the items with a window there."""
        if not self.lengths or not words:
            return [], set()
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = ids >= 0
        shortest = self.lengths[0]
        if shortest == 1:
            stretches = _runs(known)
        else:
            pair = known[:-1] & known[1:]
            at = np.nonzero(pair)[0]
            codes = ids[at] * self.size + ids[at + 1]
            place = np.searchsorted(self.pairs, codes)
            place[place == len(self.pairs)] = 0
            pair[at] = self.pairs[place] == codes if len(self.pairs) else False
            stretches = [(a, b + 1) for a, b in _runs(pair) if b + 1 - a >= shortest]
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        nxt, link, length = self.next, self.link, self.length
        for a, b in stretches:
            state = have = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in nxt[state]:
                    state = link[state]
                    have = length[state]
                if c in nxt[state]:
                    state, have = nxt[state][c], have + 1
                for n, s in self.windows[state]:
                    if n <= have:
                        items |= self.holds[n, s]
                        if hits and hits[-1][1] >= i + 1 - n:
                            while len(hits) > 1 and hits[-2][1] >= i + 1 - n:
                                hits.pop()
                            hits[-1] = (min(hits[-1][0], i + 1 - n), i + 1)
                        else:
                            hits.append((i + 1 - n, i + 1))
        return hits, items


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return list(zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist(), strict=True))


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(ascii_lower(text))


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[bytes]:
    """The items in blocks of at most ``most`` words, one block in memory at a time, as JSON ``[[id, [word, ...]], ...]``."""
    most = max(most, 2 * window)
    block, n = [], 0
    rows = items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for row in rows.toLocalIterator():
        words = words_of(row.t)
        for at in range(0, max(1, len(words) - window + 1), most - window + 1):
            piece = words[at : at + most]
            if block and n + len(piece) > most:
                yield json.dumps(block).encode()
                block, n = [], 0
            if piece:
                block.append((row.i, piece))
                n += len(piece)
    if block:
        yield json.dumps(block).encode()


def find(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Where texts hold benchmark windows: ``doc_id, text, n_words, hits, items``, a row for each row of the input.

    ``hits`` are word numbers start, end, start, end, ... of stretches that
    don't touch; ``items`` are the ids of the items that occur. Null or empty
    texts have no words; items with a null id or no words have no windows;
    repeated ids of items count once; with no items nothing is hit; an empty
    table gives no rows. No shuffle.
    """
    spark = df.sparkSession
    bound_batches(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, item_id_col, item_text_col, window, block_words)]
    narrow = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id bigint, text string, n_words bigint, hits array<int>, items array<bigint>"
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, lambda b: b.nbytes, len(blocks)):
            found = read_all([b.column(1).to_pylist() for b in lot], blocks, window)
            for batch, rows in zip(lot, found, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array([n for n, _, _ in rows], pa.int64()),
                        pa.array([[x for span in hits for x in span] for _, hits, _ in rows], ints), pa.array([sorted(keys) for _, _, keys in rows], longs),
                    ],
                    names=["doc_id", "text", "n_words", "hits", "items"],
                )

    return narrow.mapInArrow(run, schema)


def _lots(batches: Iterator, size, blocks: int) -> Iterator[list]:
    """Batches one by one; with several blocks, together up to a bound, so that an automaton is made once a lot."""
    lot, held = [], 0
    for b in batches:
        lot.append(b)
        held += size(b)
        if blocks < 2 or held >= LOT_CHARS:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def read_all(texts: list[list[str | None]], blocks: list, window: int) -> list[list[tuple[int, list, set]]]:
    """Number of words, merged hits and items of each text, over all blocks."""
    out = [[(0, [], set()) for _ in batch] for batch in texts]
    if not blocks:
        return [[(len(words_of(t)) if t else 0, [], set()) for t in batch] for batch in texts]
    for block in blocks:
        automaton = _automaton(block, window)
        for batch, rows in zip(texts, out, strict=True):
            for k, text in enumerate(batch):
                if text:
                    words = words_of(text)
                    hits, keys = automaton.read(words)
                    rows[k] = (len(words), merge(rows[k][1], hits) if rows[k][1] else hits, rows[k][2] | keys)
    return out


_built: list = []


def _automaton(block, window: int) -> Automaton:
    """Kept in a worker process until another block is asked for."""
    if not _built or _built[0] is not block or _built[1] != window:
        _built[:] = []
        _built[:] = [block, window, Automaton(json.loads(block.value), window)]
    return _built[2]


def clean_text(text: str, hits: list[tuple[int, int]], limits: Limits = Limits()) -> str | None:
    """The text without its hit spans; None if too much of it is hit.

    A span goes from its first word's first character to its last word's last.
    """
    if not hits:
        return text
    spans = [m.span() for m in WORD.finditer(ascii_lower(text))]
    if sum(e - s for s, e in hits) >= limits.coverage * len(spans):
        return None
    out, at = [], 0
    for s, e in hits:
        if e - s >= limits.span_words:
            out.append(text[at : spans[s][0]])
            at = spans[e - 1][1]
    return "".join([*out, text[at:]])


def remove(
    df: DataFrame, items: DataFrame, text_col: str = "text", limits: Limits = Limits(), window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``df`` without what the limits exclude: spans are cut out of ``text_col``, covered rows go.

    Both are decided on the hits of all items in the original text. Items of
    fewer words than a span count towards coverage and are cut only as part of
    a longer hit: alone in a long document they stay. Rows with null or empty
    texts stay; other columns stay as they are.
    """
    spark = df.sparkSession
    bound_batches(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, "item_id", "text", window, block_words)]
    if not blocks:
        return df

    @pandas_udf("string")
    def cleaned(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lot in _lots(series, lambda x: sum(len(t) for t in x if t), len(blocks)):
            texts = [x.tolist() for x in lot]
            for batch, rows in zip(texts, read_all(texts, blocks, window), strict=True):
                yield pd.Series([t if t is None else clean_text(t, hits, limits) for t, (_, hits, _) in zip(batch, rows, strict=True)], dtype=object)

    # Evaluated once a row: the filter on its result isn't moved into a second evaluation.
    once = cleaned.asNondeterministic()
    was = "_" * (1 + max(map(len, df.columns))) + "was"
    out = df.withColumn(was, F.col(text_col)).withColumn(text_col, once(F.col(was)))
    return out.where(F.col(was).isNull() | F.col(text_col).isNotNull()).drop(was)


def query(spark, sf_dir):
    """Benchmark windows in every document."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    names = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def digest(items: Iterable[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
