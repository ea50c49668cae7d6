"""Shard placement by a permutation-filled lookup table, in DataFrame operations only.

Every shard has its own preference order over the slots of a prime-sized table (an offset and a step from its name's
digest). Shards take turns, each claiming the first free slot in its order, until the table is full: each gets the same
number of slots but one, and when a shard is added or goes, few slots change hands. The table's size is fixed by its
parameter, so it is broadcast; a row's slot is a digest of its key, so placement takes constant time and no shuffle, and
rows of one key land together, evenly spread whatever their source.

Nulls and edge cases: a null key is placed like the empty string; rows that repeat go to the same shard; texts are not
read; an empty table gives an empty result; columns of docs are kept, except that `slot` and `shard`, in any case, are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 65_537  # slots: a prime, at least 100 times the shards


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot; bounded by `slots`, so it is made on the driver."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shard names must be given, distinct, and no more than slots")
    at, step = [], []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(d[:8], "big") % slots)
        step.append(int.from_bytes(d[8:16], "big") % (slots - 1) + 1)
    table, free = [-1] * slots, slots
    while free:
        for i in range(min(len(names), free)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
        free -= min(len(names), free)
    return table


def lookup(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    listed = ",".join(map(str, fill(names, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with `slot` and `shard`."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]  # names differ by more than case
    found = docs.select(*rest, slot_of(F.col(key), slots).alias("slot"))
    return found.join(F.broadcast(lookup(docs.sparkSession, shard_names(shards), slots)), "slot").select(*rest, "slot", "shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """One folder a shard; each task writes to all of them, so no shard's rows pass through one task."""
    place(docs, key, shards).drop("slot").write.partitionBy("shard").parquet(path)


ORACLE = f"""
WITH owners AS (SELECT unnest(range(0, {SLOTS})) AS slot, unnest([{",".join(map(str, fill(shard_names(SHARDS))))}]) AS shard),
placed AS (SELECT doc_id, (('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, shard::INTEGER AS shard FROM placed JOIN owners USING (slot)"""
