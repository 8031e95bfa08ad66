"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, an offset
and a stride taken from digests of its name. Shards take turns; on its turn a shard claims its
most preferred slot that is still free. The finished table is a few thousand small rows
whatever the size of the corpus, so it is broadcast and a document is placed by one look-up.
Shares differ by at most one slot, and when a shard joins or leaves most slots stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, far above the number of shards; it bounds the table that is broadcast.
SLOTS = 10007
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, use: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{use}:{name}".encode()).digest()[:8], "big")


def preference(name: str, slots: int) -> np.ndarray:
    """The order in which a shard would like the slots: a permutation, as the size is a prime."""
    offset, stride = _number(name, "offset") % slots, 1 + _number(name, "stride") % (slots - 1)
    return (offset + np.arange(slots, dtype=np.int64) * stride) % slots


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard's position for each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards: one name each, at least one")
    if slots < len(shards) or slots < 3 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, 3 or more, and no fewer than the shards")
    wishes, at, owner, free = [preference(s, slots) for s in shards], [0] * len(shards), [-1] * slots, slots
    while True:
        for i, wish in enumerate(wishes):
            while owner[wish[at[i]]] >= 0:
                at[i] += 1
            owner[wish[at[i]]] = i
            free -= 1
            if not free:
                return owner


def lookup_table(spark, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    rows = [(slot, shards[i]) for slot, i in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 15 hex digits of its SHA-256 modulo the table size; a null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Returns key, slot int, shard string: a row for each row of ``docs``, without a shuffle.

    Equal keys go to the same shard, repeated rows too; null keys go together to one shard. Spread
    a hot key by placing on a finer one (the default, doc_id, is as fine as it gets).
    Other columns are not looked at. An empty table gives an empty result.
    """
    table = F.broadcast(lookup_table(docs.sparkSession, shards, slots))  # ``slots`` rows, checked to be a stated prime
    placed = docs.select(F.col(key).alias("placed_key"), slot_of(F.col(key), slots).alias("slot"))
    return placed.join(table, "slot").select(F.col("placed_key").alias(key), "slot", "shard")


def moved(spark, before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> int:
    """How many slots change hands between two sets of shards."""
    a, b = fill(before, slots), fill(after, slots)
    return sum(before[x] != after[y] for x, y in zip(a, b, strict=True))
