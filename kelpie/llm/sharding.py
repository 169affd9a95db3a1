"""Sharding by a lookup table that shards fill in turns.

Each shard has its own order of preference over the slots of a table of prime size; in turns, each claims the next free
slot it likes best, so all shards own nearly as many slots, and a change of shards moves few of them. The table's size is
fixed by its parameter, so it is broadcast; a row finds its shard by the hash of its key in constant time.

Cases: a null key is placed by the row's payload; a key with more than its part of the rows is spread over several slots
by that payload; equal rows go to the same shard unless their key is spread and their payloads differ; an empty table gives
no rows. Columns of the input whose names clash with those added are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import apart, together

#: The most slots a table may have: about 16 MB when broadcast.
MOST_SLOTS = 1 << 20


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def lookup_table(shards: list[str], slots: int) -> np.ndarray:
    """The position in `shards` of each slot's owner."""
    if slots < 2 or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime of at most 2**20")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            left -= 1
            if not left:
                return np.asarray(owner, np.int32)


def table_frame(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    owners = lookup_table(shards, slots)
    return spark.createDataFrame([(s, int(k), shards[k]) for s, k in enumerate(owners)], "slot int, shard int, shard_name string")


def place(rows: DataFrame, key: Column, payload: Column, shards: list[str], slots: int = 65537, share: float = 0.25) -> DataFrame:
    """The rows with slot, shard (its position) and shard_name.

    A key that has more than `share` of a shard's even part of the rows is spread over as many slots as bring it below
    that. There are at most len(shards) / share such keys, so they are broadcast.
    """
    keyed = apart(rows, __key=F.xxhash64(key.cast("string"), key.isNull()), __payload=F.xxhash64(payload), __null=key.isNull())
    counts = keyed.filter("not __null").groupBy("__key").agg(F.count("*").alias("__n"))
    total = keyed.agg(F.count("*").alias("__total"))
    part = F.col("__total") * share / len(shards)
    hot = counts.filter("__n > 1").crossJoin(F.broadcast(total)).filter(F.col("__n") > F.greatest(part, F.lit(1.0))).select(F.col("__key").alias("__hot"), F.ceil(F.col("__n") / part).alias("__ways"))
    spread = keyed.join(F.broadcast(hot), F.col("__key") == F.col("__hot"), "left")  # one row of totals; hot keys are few
    turn = F.when(F.col("__null"), F.xxhash64("__payload", F.lit(1))).when(F.col("__ways").isNotNull(), F.xxhash64("__key", F.pmod("__payload", "__ways"))).otherwise(F.col("__key"))
    placed = spread.withColumn("slot", F.pmod(turn, F.lit(slots)).cast("int")).join(F.broadcast(table_frame(rows.sparkSession, shards, slots)), "slot")
    return together(placed, rows.columns, "slot", "shard", "shard_name")
