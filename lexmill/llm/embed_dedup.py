"""Near-duplicate vectors by sorted projection passes.

A pass orders all vectors lexicographically by the concatenated sign bits of
its own random projections and compares each with a bounded window of
neighbours. A sketch of sign bits leaves out pairs that are far from similar
enough; the rest are confirmed by cosine in double precision, and confirmed
pairs are united across passes. After the first passes, pairs inside a group
that is united already are passed over. The number of passes grows with the
number of vectors, so that a link is found with the same probability at any
size.

Where rows that share a long beginning of a pass's key outnumber a window and
are of several groups, all pairs between the groups are compared, in blocks of
bounded size against blocks. In the end each group is compared in full, in such
blocks too: every link inside a group counts, no pair is written out, and no
task holds more than two blocks. Equal vectors are one node with a number of
copies, whatever their ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import attach, cut, discard, table
from ._components import components
from ._sorted import neighbour_pairs

#: Least number of passes, those before groups are known, and bits of a pass's key.
PASSES, FIRST, BITS = 24, 4, 40
WINDOW, SKETCH_BITS = 16, 256
SLACK = 4.5
#: Probability, for one link at the threshold alone, that its vectors share a key's beginning in some pass.
RECALL = 0.98
#: Vectors of a block: the least and most; between, it grows with the square root of the group.
BLOCK, MOST = 512, 4_096


def plan(n: int, threshold: float) -> tuple[int, int]:
    """For ``n`` vectors: bits of a key that leave half a window of rows where vectors are spread, and the number of passes."""
    depth = max(4, min(BITS, math.ceil(math.log2(max(n, 1) / (WINDOW / 2)))))
    alike = 1 - math.acos(threshold) / math.pi
    return depth, max(PASSES, math.ceil(math.log(1 / (1 - RECALL)) / alike**depth))


def _projections(dims: int, bits: int) -> np.ndarray:
    return np.random.RandomState(dims % 2**32).standard_normal((bits, dims)).T


def hashes(vectors: DataFrame, passes: int) -> DataFrame:
    """``id, dims, keys, sketch`` of vectors ``id, v`` (bytes of doubles)."""
    total = passes * BITS

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = [len(v) // 8 for v in values]
            bits = np.empty((len(ids), total // 8), np.uint8)
            for dims in set(sizes):
                at = [k for k, s in enumerate(sizes) if s == dims]
                if dims not in known:
                    known[dims] = _projections(dims, total)
                x = np.frombuffer(b"".join(values[k] for k in at)).reshape(len(at), dims)
                x = x / np.abs(x).max(1, keepdims=True)
                bits[at] = np.packbits(x @ known[dims] > 0, axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array(ids, pa.int64()),
                    "dims": pa.array(sizes, pa.int32()),
                    "keys": pa.array([r.tobytes() for r in bits], pa.binary()),
                    "sketch": pa.array([r[: SKETCH_BITS // 8].tobytes() for r in bits], pa.binary()),
                }
            )

    return vectors.select("id", "v").mapInArrow(run, "id bigint, dims int, keys binary, sketch binary")


def compare_with(threshold: float):
    """Rows of one order and number of dimensions, within a window, whose sketches are near; not those of one group.

    A sketch has its row's group in front, eight bytes.
    """
    apart = math.acos(threshold) / math.pi
    most = SKETCH_BITS * apart + SLACK * math.sqrt(SKETCH_BITS * apart * (1 - apart))

    def compare(keys: np.ndarray, sketches: np.ndarray, group: np.ndarray):
        n, words = len(keys), np.ascontiguousarray(sketches).view(np.uint64)
        comp, words = words[:, 0], words[:, 1:]
        dims = np.ascontiguousarray(keys[:, :4]).view(np.uint32)[:, 0]
        i_all, j_all, s_all = [], [], []
        for lag in range(1, min(WINDOW, n - 1) + 1):
            i = np.nonzero((group[lag:] == group[:-lag]) & (dims[lag:] == dims[:-lag]) & (comp[lag:] != comp[:-lag]))[0]
            differ = np.bitwise_count(words[i + lag] ^ words[i]).sum(1)
            near = differ <= most
            i = i[near]
            i_all.append(i)
            j_all.append(i + lag)
            s_all.append(-differ[near].astype(np.float64))
        return np.concatenate(i_all), np.concatenate(j_all), np.concatenate(s_all)

    return compare


def unit(values: list[bytes], dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(values)).reshape(len(values), dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def confirm(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose cosine reaches the threshold."""
    side = lambda x: vectors.select(F.col("id").alias(x), F.col("v").alias(f"v{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("length(va) = length(vb)").select("a", "b", "va", "vb")

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            va, vb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(len(a), bool)
            sizes = np.array([len(v) // 8 for v in va])
            for dims in np.unique(sizes):
                at = np.nonzero(sizes == dims)[0]
                ok[at] = (unit([va[k] for k in at], dims) * unit([vb[k] for k in at], dims)).sum(1) >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _block_pairs(members: DataFrame, sizes: DataFrame, total: int, block: int | None, names: tuple[str, str], work: Callable) -> DataFrame:
    """Run ``work`` over all pairs of blocks of each group.

    ``members`` is ``grp, id, n, v`` (n: a number that goes with the id),
    ``sizes`` ``grp, m``: a group's number of members. Groups without a size
    are left out. ``work(n, x, left)`` gets the numbers and unit vectors of two
    blocks' rows of one length, the first block's ``left`` rows first (None for
    a block with itself); it returns indices of rows and a value for each.
    """
    size = F.lit(block) if block else F.least(F.greatest(8 * F.sqrt("m"), F.lit(BLOCK)), F.lit(MOST))
    cuts = sizes.select("grp", "m", F.ceil(F.col("m") / size).cast("int").alias("blocks"))
    placed = attach(members, cuts, "grp", "m", total).where("blocks is not null").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = (
        placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grp", F.least("mine", "k").alias("p"), F.greatest("mine", "k").alias("q"), "mine", "id", "n", "v")
        .repartition("grp", "p", "q")
        .sortWithinPartitions("grp", "p", "q", "mine", "id")
    )

    def run(batches):
        now, rows = None, []
        out: list[np.ndarray] = []

        def done() -> None:
            by_dims: dict[int, list] = {}
            for r in rows:
                by_dims.setdefault(len(r[3]) // 8, []).append(r)
            for dims, same in by_dims.items():
                ids = np.array([r[1] for r in same], np.int64)
                n = np.array([r[2] for r in same], np.int64)
                x = unit([r[3] for r in same], dims)
                left = sum(r[0] == now[1] for r in same)
                at, value = work(n, x, None if now[1] == now[2] else left)
                if len(at):
                    out.append(np.stack([ids[at], value]))

        def batch():
            a, b = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))

        for b in batches:
            for c, p, q, mine, key, n, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (c, p, q) != now:
                    done()
                    now, rows = (c, p, q), []
                rows.append((mine, key, n, v))
            if sum(x.shape[1] for x in out) > 20_000:
                yield batch()
        done()
        yield batch()

    return spread.mapInArrow(run, f"{names[0]} bigint, {names[1]} bigint")


def count_links(members: DataFrame, threshold: float, block: int | None = None, total: int = 0) -> DataFrame:
    """``id, others``: copies of other members of a component within the threshold, from ``component, id, n, v``."""

    def work(n, x, left):
        if left is None:
            near = x @ x.T >= threshold
            return np.arange(len(n)), near @ n - np.where(np.diagonal(near), n, 0)
        near = x[:left] @ x[left:].T >= threshold
        return np.arange(len(n)), np.concatenate([near @ n[left:], near.T @ n[:left]])

    grouped = members.withColumnRenamed("component", "grp")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("m"))
    return _block_pairs(grouped, sizes, total, block, ("id", "others"), work).groupBy("id").agg(F.sum("others").alias("others"))


def run_links(keys: DataFrame, prefix: list[Column], vectors: DataFrame, threshold: float, total: int, block: int | None = None) -> DataFrame:
    """Links ``a, b`` that unite groups within runs longer than a window, written to the shared folder.

    ``keys`` is ``tree, key, id, comp``; a run shares the tree and ``prefix``.
    Only links that join two groups of a pair of blocks are kept, a spanning forest.
    """
    member = keys.select(F.xxhash64("tree", *prefix).alias("grp"), "id", F.col("comp").alias("n"))
    runs = member.groupBy("grp").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    runs = cut(runs.where(f"m > {WINDOW + 1} and low <> high").select("grp", "m"))
    if not runs.head(1):
        discard(runs)
        return keys.sparkSession.createDataFrame([], "a bigint, b bigint")

    def work(n, x, left):
        y = slice(0, None) if left is None else slice(left, None)
        first = x[:left]
        i, j = np.nonzero((first @ x[y].T >= threshold) & (n[:left, None] != n[None, y]))
        up: dict[int, int] = {}

        def top(c):
            while (d := up.get(c, c)) != c:
                up[c] = c = up.get(d, d)
            return c

        a, b = [], []
        for u, v in zip(i.tolist(), (j + (left or 0)).tolist(), strict=True):
            s, t = top(int(n[u])), top(int(n[v]))
            if s != t:
                up[s] = t
                a.append(u)
                b.append(int(n[v]))
        return np.array(a, np.int64), np.array(b, np.int64)

    inside = attach(member, runs.withColumn("kept", F.lit(True)), "grp", "m", total).where("kept").drop("kept")
    links = cut(_block_pairs(inside.join(vectors, "id").select("grp", "id", "n", "v"), runs, total, block, ("a", "b"), work).distinct())
    discard(runs)
    return links


def classes(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: vectors linked by a cosine of ``threshold`` or more.

    A row for each row of the input, also where ids repeat: each row's vector
    counts for itself. Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows with a null id, are linked with nothing;
    vectors of different lengths aren't linked. Equal vectors are copies and
    link with each other. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    usable = (
        F.col("vec_id").isNotNull()
        & (F.size("e") > 0)
        & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("e", lambda x: x != 0)
    )
    # Two hashes with seeds of their own; a vector is told by both.
    name = F.struct(F.xxhash64(F.lit(1), "e").alias("x"), F.xxhash64(F.lit(2), "e").alias("y"))
    keyed = cut(rows.select("vec_id", F.when(usable, F.col("e")).alias("e")).select("vec_id", F.when(F.col("e").isNotNull(), name).alias("h"), "e"))
    single = keyed.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("head"), F.count("*").alias("n"), F.first("e").alias("e"))
    # Written at once, so that a node's number stays.
    nodes = cut(single.select(F.monotonically_increasing_id().alias("id"), "h", "head", "n", "e"))
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    vectors = cut(nodes.select("id", "e").mapInArrow(_as_bytes, "id bigint, v binary"))

    depth, passes = plan(n_nodes, threshold)
    width, total = BITS // 8, n_nodes * passes
    hashed = cut(hashes(vectors, passes))

    def keys(first: int, last: int, comps: DataFrame | None) -> DataFrame:
        """Rows of some passes, with the groups so far (an unlinked vector's own number)."""
        comp = F.col("id") if comps is None else F.coalesce("component", "id")
        known = hashed if comps is None else hashed.join(comps, "id", "left")
        each = known.select(F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("tree"), "id", "dims", "keys", "sketch", comp.alias("comp"))
        key = f"concat(unhex(lpad(hex(dims), 8, '0')), substring(keys, tree * {width} + 1, {width})) as key"
        return each.selectExpr("tree", key, "id", "comp", "concat(unhex(lpad(hex(comp), 16, '0')), sketch) as sketch")

    def linked(first: int, last: int, comps: DataFrame | None) -> DataFrame:
        pairs = cut(neighbour_pairs(keys(first, last, comps), compare_with(threshold), WINDOW))
        links = cut(confirm(pairs, vectors, threshold))
        discard(pairs)
        return links

    early = linked(0, FIRST, None)
    links = early.union(linked(FIRST, passes, cut(components(early))))
    groups = cut(components(links))
    prefix = [F.expr("substring(key, 1, 4)"), F.expr(f"shiftright(cast(conv(hex(substring(key, 5, {width})), 16, 10) as bigint), {BITS - depth})")]
    more = run_links(keys(0, passes, groups), prefix, vectors, threshold, total)
    if more.head(1):
        # The second end of such a link is a group's number, which is a node of that group.
        groups = cut(components(links.union(more)))
    counts = count_links(groups.join(nodes.select("id", "n"), "id").join(vectors, "id").select("component", "id", "n", "v"), threshold, total=n_nodes)
    own = groups.join(nodes.select("id", "head"), "id")
    least = own.groupBy("component").agg(F.min("head").alias("least"), F.count("*").alias("m"))
    placed = attach(own.select("component", "id"), least, "component", "m", n_nodes).select("id", "least").join(counts, "id", "left")
    node = nodes.select("id", "h", "head", "n").join(placed, "id", "left").select(
        "h", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "head").alias("component")
    )
    out = attach(keyed.select("vec_id", "h"), cut(node), "h", "n", n_rows).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    for done in (hashed, vectors, early):
        discard(done)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _as_bytes(batches):
    for b in batches:
        values = [np.asarray(v, np.float64).tobytes() for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], names=["id", "v"])


def query(spark, sf_dir):
    """Near copies among all vectors at a cosine of 0.9."""
    return classes(table(spark, sf_dir, "embeddings"))
