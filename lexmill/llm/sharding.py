"""Shard placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: a
start and a stride, both from a hash of its name. Shards take turns (a heavier
shard takes more turns a round) and each claims its first free preference until
the table is full. A key is placed by one hash and one table look-up, and a
shard that goes away moves few keys other than its own.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

#: A prime well above a hundred times the shards, so that shares differ by under one percent.
TABLE_SIZE = 65_537
#: The table is broadcast; its size is this parameter's and never the data's.
MAX_TABLE_SIZE = 4_194_301


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def build_table(shards: list[str], weights: list[int] | None = None, size: int = TABLE_SIZE) -> array:
    """The slot -> shard index table. ``size`` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if size > MAX_TABLE_SIZE or size < len(shards) or not _is_prime(size):
        raise ValueError(f"size must be a prime from {len(shards)} to {MAX_TABLE_SIZE}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("weights must be positive, one a shard")
    at = [_hash(s, "start") % size for s in shards]
    stride = [_hash(s, "stride") % (size - 1) + 1 if size > 1 else 0 for s in shards]
    slots, left = array("i", [-1]) * size, size
    while left:
        for k, turns in enumerate(weights):
            for _ in range(turns):
                if not left:
                    break
                while slots[at[k]] >= 0:
                    at[k] = (at[k] + stride[k]) % size
                slots[at[k]] = k
                left -= 1
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot: the first 60 bits of the MD5 of its text, modulo the table. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size))


def place(
    df: DataFrame,
    key: str,
    shards: list[str],
    weights: list[int] | None = None,
    size: int = TABLE_SIZE,
    slot_col: str = "slot",
    shard_col: str = "shard_id",
) -> DataFrame:
    """Add the slot and shard index of each row's key; no shuffle, one broadcast of ``size`` integers.

    Equal keys get equal shards, so repeated rows stay together. Columns of the
    input that have the names of the new ones are replaced. An empty input gives
    an empty result with the same columns.
    """
    spark = df.sparkSession
    slots = build_table(shards, weights, size)
    lookup = spark.createDataFrame(list(enumerate(slots)), f"`{slot_col}` bigint, `{shard_col}` int")
    keep = [c for c in df.columns if c not in (slot_col, shard_col) or c == key]
    if key in (slot_col, shard_col):
        raise ValueError("the key needs a name other than the new columns'")
    return df.select(*keep, slot_of(F.col(key), size).alias(slot_col)).join(F.broadcast(lookup), slot_col)


SHARDS = [f"shard-{k:03d}" for k in range(64)]


def query(spark, sf_dir):
    """Every document's shard of 64."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard_id")


def _sql() -> str:
    """The same placement: the first 60 bits of the MD5, and the table as two hexadecimal digits a slot."""
    slots = "".join(f"{k:02x}" for k in build_table(SHARDS))
    number = "cast('0x' || {} as bigint)"
    return f"""
with s as (select doc_id, {number.format("substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15)")} % {TABLE_SIZE} as slot from documents)
select doc_id, slot, cast({number.format(f"substr('{slots}', cast(slot * 2 + 1 as integer), 2)")} as integer) as shard_id from s
"""


SQL = _sql()
