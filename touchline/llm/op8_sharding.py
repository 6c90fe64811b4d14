"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size (offset
and stride from two hashes of its name). Shards take turns claiming the next free
slot in their order of preference until the table is full, so shares differ by
one slot at most, and a change of the shard list moves few slots. The table's
size is a parameter, so its broadcast is bounded; a row's place is one lookup.

Defined results: a null key takes the slot of the empty text; equal keys, repeated
rows among them, share a shard; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table

#: A prime well over 100 times the number of shards.
SLOTS = 65_537
SHARDS = 64


def lookup_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """Slot -> index of the shard that holds it."""
    if not names:
        raise ValueError("no shards")
    if len(set(names)) < len(names):
        raise ValueError("shard names repeat")
    if len(names) > slots or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    raw = [hashlib.sha256(x.encode()).digest() for x in names]
    offset = [int.from_bytes(x[:8], "big") % slots for x in raw]
    stride = [int.from_bytes(x[8:16], "big") % (slots - 1) + 1 for x in raw]
    owner = np.full(slots, -1, np.int32)
    turn = np.array(offset, np.int64)
    left = slots
    while left:
        for k in range(len(names)):
            while owner[turn[k]] >= 0:
                turn[k] = (turn[k] + stride[k]) % slots
            owner[turn[k]] = k
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def assign_shards(rows: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """The key, its slot and its shard. No shuffle: a broadcast table of `slots` rows."""
    names = names or [f"shard-{k:04d}" for k in range(SHARDS)]
    owner = lookup_table(names, slots)
    spark = rows.sparkSession
    held = spark.createDataFrame([(i, int(k), names[k]) for i, k in enumerate(owner)], "slot int, shard int, shard_name string")
    return rows.select(F.col(key), slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(held), "slot").select(key, "slot", "shard", "shard_name")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
