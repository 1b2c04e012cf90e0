"""Neighbours in globally sorted orders: the candidate search of both near-duplicate operators.

Rows of several orders are sorted by (order, key, id) over all partitions. A
task compares each row with the next few in its partition, in vectorised
blocks that overlap; rows at partition edges, through partitions shorter than a
window too, are compared in a second, small pass. The range partitioner splits runs of equal keys by id, so a large group
of copies spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

ROWS = "part int, tree int, key binary, id bigint, sketch binary"
BLOCK = 40_000

#: From the keys (rows x bytes), sketches and group numbers of sorted rows: index pairs and a score.
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def neighbour_pairs(rows: DataFrame, compare: Compare, window: int) -> DataFrame:
    """Candidate pairs ``a, b, score`` (a < b, each once, with its best score) of rows ``tree, key, id, sketch``.

    Keys, and sketches, all have one length. ``compare`` looks at most
    ``window`` rows ahead. The result is written to the shared folder.
    """
    ordered = rows.select("tree", "key", "id", "sketch").repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    first = cut(ordered.mapInArrow(_scan(compare, window, edges=True), f"a bigint, b bigint, score float, last boolean, {ROWS}"))
    pairs = first.where("a is not null").select("a", "b", "score")
    edges = first.where("a is null")
    sizes = dict(edges.where("not last").groupBy("part").count().collect())  # of each partition, a window's rows at most
    if len(sizes) > 1:
        reach = sorted(_reach(sorted(sizes.items()), window))
        borders = F.broadcast(rows.sparkSession.createDataFrame(reach, "part int, last boolean, border int"))
        at_edge = (
            edges.join(borders, ["part", "last"])
            .select(F.col("border").alias("part"), "tree", "key", "id", "sketch")
            .dropDuplicates(["part", "tree", "id", "key"])
            .repartition("part")
            .sortWithinPartitions("part", "tree", "key", "id")
        )
        pairs = pairs.union(at_edge.mapInArrow(_scan(compare, window, edges=False), "a bigint, b bigint, score float"))
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score"))


def _reach(sizes: list[tuple[int, int]], window: int) -> set[tuple[int, bool, int]]:
    """At which borders a partition's first or last rows stand: ``part, last, border``.

    Border k lies behind the k-th partition. A window goes on through
    partitions that have fewer rows than it.
    """
    out = set()
    for k, (part, _) in enumerate(sizes):
        for step, last in ((1, True), (-1, False)):
            seen, at = 0, k
            while 0 <= at + step < len(sizes) and seen < window:
                out.add((part, last, at if last else at - 1))
                at += step
                seen += sizes[at][1]
    return out


def _scan(compare: Compare, window: int, edges: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: pa.Table | None = None
        started = False
        for batch in _blocks(batches):
            held = batch if held is None else pa.concat_tables([held, batch]).combine_chunks()
            if edges and not started:
                yield _edge(held.slice(0, window), part, False)
                started = True
            yield from _compared(held, compare, edges)
            held = held.slice(max(0, held.num_rows - window))
        if edges and held is not None and held.num_rows:
            yield _edge(held.slice(max(0, held.num_rows - window)), part, True)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting, n = [], 0
    for b in batches:
        waiting.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _compared(rows: pa.Table, compare: Compare, wide: bool) -> Iterator[pa.RecordBatch]:
    if rows.num_rows < 2:
        return
    group = rows.column("tree").to_numpy().astype(np.int64)
    if "part" in rows.column_names:
        group = group + (rows.column("part").to_numpy().astype(np.int64) << 32)
    ids = rows.column("id").to_numpy()
    i, j, score = compare(_bytes(rows.column("key")), _bytes(rows.column("sketch")), group)
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    keep = a != b
    a, b, score = a[keep], b[keep], score[keep].astype(np.float32)
    # A pair found in the block before, in the overlap or in another order is the same pair: one row of it is enough.
    if len(a):
        _, at = np.unique(np.stack([a, b]), axis=1, return_index=True)
        yield _pair_batch(a[at], b[at], score[at], wide)


def _pair_batch(a, b, score, wide: bool) -> pa.RecordBatch:
    arrays = {"a": pa.array(a), "b": pa.array(b), "score": pa.array(score)}
    if wide:
        none = lambda t: pa.nulls(len(a), t)
        arrays |= {"last": none(pa.bool_()), "part": none(pa.int32()), "tree": none(pa.int32()), "key": none(pa.binary()), "id": none(pa.int64()), "sketch": none(pa.binary())}
    return pa.RecordBatch.from_pydict(arrays)


def _edge(rows: pa.Table, part: int, last: bool) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_pydict(
        {
            "a": pa.nulls(n, pa.int64()), "b": pa.nulls(n, pa.int64()), "score": pa.nulls(n, pa.float32()),
            "last": pa.array([last] * n), "part": pa.array([part] * n, pa.int32()), "tree": pa.array(rows.column("tree").to_pylist(), pa.int32()),
            "key": pa.array(rows.column("key").to_pylist(), pa.binary()), "id": pa.array(rows.column("id").to_pylist(), pa.int64()),
            "sketch": pa.array(rows.column("sketch").to_pylist(), pa.binary()),
        }
    )
