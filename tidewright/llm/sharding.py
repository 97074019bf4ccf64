"""Sharding by a permutation-filled lookup table: constant-time, even and stable placement."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS_PER_SHARD = 100


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def lookup_table(shards: Sequence[str], slots: int | None = None) -> list[int]:
    """Slot to index in ``shards``: shards take turns claiming their next preferred free slot.

    A shard's preferences are offset + k * skip modulo the prime size, both from a hash of its name, so a shard
    that joins or leaves moves few slots of the others.
    """
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    size = next_prime(slots or SLOTS_PER_SHARD * len(shards))
    if size < len(shards):
        raise ValueError("fewer slots than shards")
    order = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        order.append([int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1 if size > 2 else 1])
    table = [-1] * size
    left = size
    while left:
        for k, pair in enumerate(order):
            while table[pair[0]] >= 0:
                pair[0] = (pair[0] + pair[1]) % size
            table[pair[0]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key's text: the first 60 bits of its MD5 modulo the prime size (a null key counts as '')."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int | None = None, prefix: str = "") -> DataFrame:
    """``df`` with ``slot``, ``shard`` (index) and ``shard_name``; same-named input columns are replaced.

    Equal keys share a shard, nulls too; the table (one integer per slot, its size fixed by the number of shards)
    is the broadcast side of a join on the slot.  No row is moved: write with ``partitionBy`` or
    ``repartitionByRange`` as the sink needs.  An empty table gives an empty result.
    """
    table = lookup_table(shards, slots)
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    spark = df.sparkSession
    slot, shard, name = f"{prefix}slot", f"{prefix}shard", f"{prefix}shard_name"
    side = (
        spark.range(1, numPartitions=1)
        .select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias(slot, "_claim"))
        .select(slot, F.col("_claim").cast("int").alias(shard))
        .withColumn(name, F.get(names, F.col(shard)))
    )
    keep = [c for c in df.columns if c not in (slot, shard, name)]
    placed = df.select(*keep, slot_of(F.col(key), len(table)).alias(slot))
    return placed.join(F.broadcast(side), slot).select(*keep, slot, shard, name)
