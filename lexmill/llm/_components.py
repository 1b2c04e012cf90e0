"""Connected components of links, by alternating star contractions with durable rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import attach, cut, discard


#: Links that a task contracts at a time.
ONE_TASK = 200_000


def _contract(links: DataFrame) -> DataFrame:
    """Contract the links of a task, up to ``ONE_TASK`` at a time: every node to the smallest it reaches there."""

    def run(batches):
        up: dict[int, int] = {}
        seen = 0

        def top(x):
            path = []
            while (y := up.get(x, x)) != x:
                path.append(x)
                x = y
            for p in path:
                up[p] = x
            return x

        def done():
            nodes = list(up)
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["a", "b"])
            up.clear()
            return out

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            seen += batch.num_rows
            if seen >= ONE_TASK:
                yield done()
                seen = 0
        yield done()

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


#: A node with more links than this, and than one in so many of all, is a hub: its links are joined where they lie.
HUB, SHARE = 20_000, 200


def _with_least(links: DataFrame, least: DataFrame, hub: bool, total: int) -> DataFrame:
    return attach(links, least, "a", "n", 2 * total) if hub else links.join(least.drop("n"), "a")


def _large_star(links: DataFrame, hub: bool, total: int) -> DataFrame:
    """Each node's larger neighbours go to the smallest of it and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.sum((F.col("b") > F.col("a")).cast("int")).alias("n"))
    return _with_least(both.where("b > a"), least, hub, total).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(links: DataFrame, hub: bool, total: int) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _with_least(links, least, hub, total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _has_hub(links: DataFrame, total: int) -> bool:
    """If many links end in one node; asked only where there are enough links for one."""
    if total <= HUB:
        return False
    most = links.groupBy("b").count().agg(F.max("count")).first()[0]
    return most > max(HUB, total // SHARE)


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``id, component`` for every node that a link ``a, b`` (bigint) joins to another: the smallest id it reaches.

    Links may repeat, in either order; nulls and links of a node to itself are
    left out. Links are contracted where they lie; if no more than ``one_task``
    are left then, one task settles them. Beyond, two star operations alternate
    over all links until nothing changes (about the logarithm of the longest
    chain). Aggregation is partial before each shuffle, a hub's links are joined
    where they lie, and every round is written to the shared folder.
    """
    clean = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    now = cut(_contract(clean).distinct())
    mark = _print(now)
    if 0 < mark[0] <= min(one_task, ONE_TASK):
        whole = cut(_contract(now.coalesce(1)))
        discard(now)
        now, most_rounds = whole, 0
    for _ in range(most_rounds):
        if not mark[0]:
            break
        hub = _has_hub(now, mark[0])
        new = cut(_contract(_small_star(_large_star(now, hub, mark[0]), hub, mark[0])).distinct())
        discard(now)
        now, was, mark = new, mark, _print(new)
        if mark == was and not now.join(now.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").head(1):
            break
    else:
        if most_rounds:
            raise RuntimeError(f"links didn't settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
