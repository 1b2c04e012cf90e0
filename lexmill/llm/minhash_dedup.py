"""Near-duplicate documents by a MinHash LSH forest.

A document's set is its distinct word shingles. A tree orders documents by the
concatenation of ``DEPTH`` minimum hashes; documents that share a long prefix
stand side by side. Each is compared with its next neighbours. How deep a
prefix must be shared adapts to the region: a sparse region compares all that
share ``LEAST`` hashes, a dense one only runs deep enough to have a window's
rows, besides each row's nearest two. Several trees with hashes of their own
leave little to chance, whatever the number of documents.

Equal sets are one node. A candidate's sketch, a byte of each of some hashes,
leaves out what is far from similar enough; the rest are confirmed on full sets
from whole texts: first each node's most similar candidate, which joins most of
every group, then the candidates that still lie between two groups.

A run of more rows than a window that share ``LEAST`` hashes isn't left at its
windows: where it still holds several groups, all of its pairs between groups
are compared on full sets, in blocks of bounded size against blocks. Only links
that join two groups are written, so a run costs time but no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import attach, bound_batches, cut, discard, map_arrow, table, text_or_empty
from ._components import components
from ._sorted import neighbour_pairs

TREES, DEPTH, LEAST, WINDOW, NEAREST = 16, 8, 4, 8, 2
SKETCH = 64
#: Standard errors that a sketch's estimate may lie below the threshold.
SLACK = 4.5
#: Ids that may be broadcast to pick the texts to confirm (16 MB); beyond, a shuffle picks them.
BROADCAST_IDS = 2_000_000
WORDS_KEPT = 100_000
#: Documents, and their shingles, of a block of the full comparison in a long run.
BLOCK, BLOCK_SHINGLES = 1_024, 500_000
#: Columns of a dense part of the incidence matrix, and the pairs a multiplied cell of it is worth.
COLUMNS, PAIR_COST = 4_096, 300_000
_RANDOM = np.random.RandomState(20_240_229)
_MULTIPLY = _RANDOM.randint(0, 2**63, TREES * DEPTH).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.randint(0, 2**63, TREES * DEPTH).astype(np.uint64)
#: Odd multipliers of a shingle's words (any number of words, by powers).
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                total = _mix(total * _STEP + h[k : len(h) - n + 1 + k])
        return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each hash function, as 32 bits."""
    least = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048, None] * _MULTIPLY + _ADD
            np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(0), out=least)
    return least


def signatures(df: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_hash, sig, sketch``; a set without shingles has null for the last three."""

    def start():
        import xxhash

        shingle = Shingler(words)

        def step(columns):
            out: list[list] = [columns[0], [], [], [], []]
            for text in columns[1]:
                s = shingle(text)
                sig = signature(s) if len(s) else None
                out[1].append(len(s))
                out[2].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out[3].append(sig.astype(">u4").tobytes() if len(s) else None)
                out[4].append((sig[:SKETCH] & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            return out

        return step

    columns = [F.col(id_col).cast("bigint"), text_or_empty(text_col)]
    return map_arrow(df, columns, "doc_id bigint, n_shingles bigint, set_hash binary, sig binary, sketch binary", start)


def _least_score(threshold: float) -> float:
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SKETCH)


def compare_with(threshold: float):
    """The forest's comparison of sorted rows; see the module's text."""
    least_score = _least_score(threshold)

    def compare(keys: np.ndarray, sketches: np.ndarray, group: np.ndarray):
        n, width = len(keys), keys.shape[1] // 4
        same_group = group[1:] == group[:-1]
        equal = (keys[1:] == keys[:-1]).reshape(n - 1, width, 4).all(2)
        shared = np.cumprod(equal, axis=1).sum(1) * same_group  # hashes shared with the row before
        depth = np.full(n, width, np.int64)
        for d in range(width - 1, LEAST - 1, -1):
            run = np.concatenate(([0], np.cumsum(shared < d)))
            depth[np.bincount(run)[run] <= WINDOW + 1] = d
        found_i, found_j, found_s = [], [], []
        prefix = shared.copy()  # hashes shared by i and i + lag: the least on the way
        for lag in range(1, min(WINDOW, n - 1) + 1):
            if lag > 1:
                prefix = np.minimum(prefix[:-1], shared[lag - 1 :])
            need = LEAST if lag <= NEAREST else np.maximum(depth[: n - lag], LEAST)
            i = np.nonzero(prefix >= need)[0]
            if len(i):
                score = (sketches[i] == sketches[i + lag]).mean(1)
                ok = score >= least_score
                found_i.append(i[ok])
                found_j.append(i[ok] + lag)
                found_s.append(score[ok])
        if not found_i:
            none = np.empty(0, np.int64)
            return none, none, none.astype(np.float64)
        return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_s)

    return compare


def full_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, shingles`` (sorted 64-bit hashes) from the whole texts of ``docs`` with an id of ``ids``, written to the shared folder."""
    wanted = cut(ids.distinct())
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.where("doc_id is not null").join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "doc_id", "left_semi")

    def start():
        shingle = Shingler(words)
        return lambda columns: [columns[0], [shingle(t).tobytes() for t in columns[1]]]

    sets = cut(map_arrow(texts, [F.col("doc_id"), F.col("text")], "doc_id bigint, shingles binary", start).groupBy("doc_id").agg(F.min("shingles").alias("shingles")))
    discard(wanted)
    return sets


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough, from the texts of ``docs`` (doc_id, text)."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    sets = full_sets(ids, docs, words)
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def start():
        def step(columns):
            a, b = [], []
            for x, y, s, t in zip(*columns, strict=True):
                # A set that is too small for the other can't reach the threshold.
                if len(s) and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                    common = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
                    if 100 * common >= percent * ((len(s) + len(t)) // 8 - common):
                        a.append(x)
                        b.append(y)
            return a, b

        return step

    links = cut(map_arrow(both, [F.col(c) for c in ("a", "b", "set_a", "set_b")], "a bigint, b bigint", start))
    discard(sets)
    return links


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared elements of each set of ``left`` with each of ``right``."""
    every = [*left, *right]
    _, column, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    often = count > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        x = np.zeros((len(every), COLUMNS), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def joins(left: list, right: list | None, percent: int) -> list[tuple[int, int]]:
    """Links between different groups of ``left`` and ``right`` (or of ``left`` alone) that unite them, a spanning forest.

    A row is ``id, component, sketch, set``; every pair that its sketches don't rule out is decided on its sets.
    """
    other = left if right is None else right
    sides = [left, other]
    comps = [np.array([r[1] for r in side], np.int64) for side in sides]
    sizes = [np.array([len(r[3]) for r in side], np.int64) for side in sides]
    marks = [np.frombuffer(b"".join(r[2] for r in side), np.uint8).reshape(len(side), SKETCH) for side in sides]
    least = _least_score(percent / 100)
    maybe = []
    for at in range(0, len(left), 32):
        part = slice(at, at + 32)
        ok = (marks[0][part, None] == marks[1][None]).mean(2) >= least
        ok &= comps[0][part, None] != comps[1][None]
        ok &= 100 * np.minimum(sizes[0][part, None], sizes[1]) >= percent * np.maximum(sizes[0][part, None], sizes[1])
        if right is None:
            ok &= np.arange(at, at + len(ok))[:, None] < np.arange(len(other))
        i, j = np.nonzero(ok)
        maybe.append(np.stack([i + at, j]))
    i, j = np.concatenate(maybe, axis=1)
    if not len(i):
        return []
    up: dict[int, int] = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    rows, columns = np.unique(i), np.unique(j)
    sets = [left[k][3] for k in rows], [other[k][3] for k in columns]
    if len(rows) * len(columns) * (sum(map(len, sets[0])) + sum(map(len, sets[1]))) < PAIR_COST * len(i):
        shared = common(*sets)[np.searchsorted(rows, i), np.searchsorted(columns, j)]
        near = 100 * shared >= percent * (sizes[0][i] + sizes[1][j] - shared)
        i, j, known = i[near], j[near], True
    else:
        known = False
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(left[x][1]), top(other[y][1])
        if a == b:
            continue
        if not known:
            n = len(np.intersect1d(left[x][3], other[y][3], assume_unique=True))
            if 100 * n < percent * (len(left[x][3]) + len(other[y][3]) - n):
                continue
        up[a] = b
        out.append((left[x][0], other[y][0]))
    return out


def run_links(nodes: DataFrame, linked: DataFrame, docs: DataFrame, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that unite groups within runs longer than a window, written to the shared folder.

    ``nodes`` is ``doc_id, n_shingles, sig, sketch``, ``linked`` the groups so
    far. A group of more than a block in a run has blocks of its own, which
    aren't compared with one another; the rest of the run shares blocks.
    """
    spark = nodes.sparkSession
    bound_batches(spark)
    tree = nodes.join(linked.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select(
        F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig", F.col("doc_id").alias("id"), F.coalesce("component", "doc_id").alias("comp"), "n_shingles"
    )
    member = tree.select(F.expr(f"xxhash64(tree, substring(sig, tree * {4 * DEPTH} + 1, {4 * LEAST}))").alias("run"), "id", "comp", "n_shingles")
    need = F.greatest(F.count("*") / F.lit(block), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
    parts = member.groupBy("run", "comp").agg(F.count("*").alias("m"), need.alias("need"))
    runs = (
        parts.groupBy("run")
        .agg(F.sum("m").alias("n"), F.count("*").alias("comps"), F.ceil(F.sum(F.when(F.col("need") <= 1, F.col("need")))).alias("pool"))
        .where(f"n > {WINDOW + 1} and comps > 1")
        .select("run", F.coalesce("pool", F.lit(1)).alias("pool"))
    )
    split = cut(parts.join(runs, "run").select("run", "comp", "need", "pool"))
    own = F.col("need") > 1
    k = F.when(own, F.pmod(F.xxhash64("id"), F.ceil("need"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("pool")))
    placed = cut(
        member.join(split, ["run", "comp"]).select(
            "run", "id", "comp", F.when(own, F.col("comp")).alias("owner"), F.concat_ws(":", F.when(own, F.col("comp").cast("string")).otherwise("-"), k.cast("string")).alias("block")
        )
    )
    blocks = cut(placed.groupBy("run", "block").agg(F.first("owner").alias("owner")))
    x, y = (blocks.select("run", F.col("block").alias(c), F.col("owner").alias(f"o{c}")) for c in "xy")
    pairs = x.join(y, "run").where("x <= y and not coalesce(ox = oy, false)").select("run", "x", "y")
    tasks = pairs.select("run", "x", "y", F.col("x").alias("block")).union(pairs.where("x <> y").select("run", "x", "y", F.col("y").alias("block")))

    sets = full_sets(placed.select(F.col("id").alias("doc_id")), docs, words).withColumnRenamed("doc_id", "id")
    full = sets.join(nodes.select(F.col("doc_id").alias("id"), "sketch"), "id")
    spread = (
        placed.select("run", "block", "id", "comp").join(tasks, ["run", "block"]).join(full, "id")
        .select("run", "x", "y", "block", "id", "comp", "sketch", "shingles")
        .repartition("run", "x", "y")
        .sortWithinPartitions("run", "x", "y")
    )

    def compare(batches):
        now, left, right = None, [], []

        def done():
            links = joins(left, None if now[1] == now[2] else right, percent) if left and (right or now[1] == now[2]) else []
            a, b = ([min(p) for p in links], [max(p) for p in links])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for run, p, q, mine, key, comp, sketch, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (run, p, q) != now:
                    if now:
                        yield done()
                    now, left, right = (run, p, q), [], []
                (left if mine == p else right).append((key, comp, sketch, np.frombuffer(s, np.uint64)))
        if now:
            yield done()

    links = cut(spread.mapInArrow(compare, "a bigint, b bigint").distinct())
    for done in (split, placed, blocks, sets):
        discard(done)
    return links


def classes(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: groups of documents linked by ``percent`` or more similarity.

    A row for each row of the input. A text of fewer words than a shingle is
    one shingle; a null text, or one without words, has none and is linked with
    nothing. A null id is linked with nothing and has a null component, and is
    kept. Rows that repeat an id count as one document. Ties of group heads go
    to the smallest id; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = cut(signatures(docs, words))
    known = signed.where("doc_id is not null and set_hash is not null")
    heads = cut(known.groupBy("set_hash").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")))
    nodes = known.join(heads.select("set_hash", F.col("head").alias("doc_id")), ["set_hash", "doc_id"], "left_semi")
    rows = nodes.select(
        F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig", F.col("doc_id").alias("id"), "sketch"
    ).selectExpr("tree", f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH}) as key", "id", "sketch")
    pairs = cut(neighbour_pairs(rows, compare_with(percent / 100), WINDOW))

    ends = pairs.select("a", "b", "score").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    best = ends.groupBy("a").agg(F.max(F.struct("score", -F.col("b"))).alias("m")).select("a", (-F.col("m.col2")).alias("b"))
    first = confirm(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, words, percent)
    joined = cut(components(first))
    at = lambda x: joined.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    rest = (
        pairs.join(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
        .join(at("a"), "a", "left")
        .join(at("b"), "b", "left")
        .where("coalesce(ca, a) <> coalesce(cb, b)")
    )
    second = confirm(cut(rest.select("a", "b")), docs, words, percent)
    linked = cut(components(first.union(second))) if second.head(1) else joined
    third = run_links(nodes.select("doc_id", "n_shingles", "sig", "sketch"), linked, docs, words, percent)
    if third.head(1):
        linked = components(first.union(second).union(third))
    member = heads.join(linked.select(F.col("id").alias("head"), "component"), "head", "left").select(
        "set_hash", "n", F.coalesce("component", "head").alias("component")
    )
    own = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    out = attach(own, member, "set_hash", "n", signed.count()).select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_heads(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: that of its smallest id; all columns stay as they are.

    Of rows that repeat an id, the one whose text is first in order stays (of
    equal texts, that with the smallest hash of its other columns). Rows with a
    null id stay. Texts of ids that don't repeat aren't shuffled unless more
    than ``BROADCAST_IDS`` documents go.
    """
    found = cut(classes(df, words, percent, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept")))
    wide = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    name = "_" * (1 + max(map(len, df.columns))) + "id"
    match = F.col(f"`{id_col}`").cast("bigint") == F.col(name)
    left = df.join(wide(found.where("not kept").select(F.col("doc_id").alias(name))), match, "left_anti")
    often = found.where("kept and rows > 1").select(F.col("doc_id").alias(name))
    if not often.head(1):
        return left
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    order = F.struct(F.col(text_col).isNull(), F.col(text_col), F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    repeated = left.join(wide(often), match, "left_semi").groupBy(F.col(id_col).alias(name)).agg(F.min_by(F.struct("*"), order).alias("row"))
    return left.join(wide(often), match, "left_anti").unionByName(repeated.select("row.*"))


def query(spark, sf_dir):
    """Near copies among all documents: sets of three words, similarity 0.85."""
    return classes(table(spark, sf_dir, "documents"), words=3, percent=85)
