"""Operator 8: sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table and shards take turns
claiming the first free slot of theirs, until none is free.  So shards own equally many slots (but
for one), and a shard that comes or goes moves few slots of the others.  A document's slot is a
hash of its key; its shard is read from the table, which is broadcast: its size is a parameter and
does not follow the data.

Null ids share one slot; repeated rows get the same shard; texts, however long, and other columns
are not read.  The key's column may not be called slot or shard.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def fill_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> np.ndarray:
    """The shard (by place in ``shards``) of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if slots < 2 * len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least twice as many as shards")
    # A prime size makes every step width visit all slots.
    preference = [(_number(s, "offset") % slots, _number(s, "step") % (slots - 1) + 1) for s in shards]
    owner, turn, free = np.full(slots, -1, np.int32), [0] * len(shards), slots
    while True:
        for i, (offset, step) in enumerate(preference):
            slot = (offset + turn[i] * step) % slots
            while owner[slot] >= 0:
                turn[i] += 1
                slot = (offset + turn[i] * step) % slots
            owner[slot] = i
            turn[i] += 1
            free -= 1
            if not free:
                return owner


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) of each row."""
    if key.lower() in ("slot", "shard"):
        raise ValueError("the key's column has the name of a result's")
    spark = docs.sparkSession
    owner = fill_table(shards, slots)
    lookup = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot long, shard string")
    keyed = docs.select(F.col(key), F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).alias("slot"))
    return keyed.join(F.broadcast(lookup), "slot").select(key, "slot", "shard")


def op8_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
