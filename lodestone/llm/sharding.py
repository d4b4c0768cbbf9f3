"""Consistent sharding by a permutation-filled lookup table.

Every shard has a permutation of the table's slots, from two hashes of its name. The shards take turns: each claims
the first free slot of its permutation, until no slot is free. The table has a prime number of slots, so every step
width visits all of them. A row's slot is a hash of its key; the table (SLOTS rows, fixed) is broadcast, so placement
takes constant time and no shuffle, and adding or removing a shard moves few keys besides those it must.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, over a hundred times the usual number of shards.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's place in `shards`, for every slot. Slots per shard differ by one at most."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or not is_prime(slots):
        raise ValueError("shards must be distinct, one at least and no more than slots, and slots a prime")
    steps = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        steps.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1))
    table, at = [-1] * slots, [offset for offset, _ in steps]
    turn, left = 0, slots
    while left:
        slot, step = at[turn], steps[turn][1]
        while table[slot] >= 0:
            slot = (slot + step) % slots
        table[slot], at[turn] = turn, (slot + step) % slots
        left -= 1
        turn = (turn + 1) % len(shards)
    return table


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard.

    The slot depends on the key columns alone (as strings; a null key has a place of its own), so repeated rows go
    together. Columns of df named slot or shard are replaced. An empty table stays empty.
    """
    table = df.sparkSession.createDataFrame([(i, shards[x]) for i, x in enumerate(fill(shards, slots))], "slot bigint, shard string")
    slot = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(slots).cast("bigint"))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return df.withColumn("__slot", slot).select(*kept, F.col("__slot").alias("slot")).join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def write_sharded(df: DataFrame, keys: list[str], shards: list[str], path: str, parts: int = 1) -> None:
    """Write one folder per shard, each in `parts` files or more; rows of a shard are dealt by key and salt, so no task holds a whole shard unless it fits."""
    placed = place(df, keys, shards)
    salt = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(1)), F.lit(parts))
    placed.repartition(len(shards) * parts, "shard", salt).drop("slot").write.partitionBy("shard").parquet(path)
