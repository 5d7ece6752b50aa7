"""Operator 7: sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (an offset and a step drawn from its name);
shards take turns and claim their next free slot until the table is full.  The slots of two shards differ by one at
most, and adding or removing a shard moves few slots.  Rows are placed by key hash modulo the table size: one broadcast
look-up, no shuffle.

Defined results: a null key is placed by ``fallback`` (the query uses the text) and, if that is null too, as the empty
key; equal keys share a shard; rows and other columns are returned unchanged.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """slot -> index of the shard.  Configuration work on the driver: ``size`` turns, whatever the data."""
    if not _is_prime(size):
        raise ValueError("the table size must be prime")
    if not shards or len(shards) > size or len(set(shards)) != len(shards):
        raise ValueError("between one and table-size distinct shard names are needed")
    nexts, steps = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).hexdigest()
        nexts.append(int(digest[:15], 16) % size)
        steps.append(int(digest[15:30], 16) % (size - 1) + 1 if size > 2 else 1)
    table, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            slot = nexts[i]
            while table[slot] >= 0:
                slot = (slot + steps[i]) % size
            table[slot], nexts[i] = i, (slot + steps[i]) % size
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % size


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard, shard_name); its size is fixed by the parameter."""
    packed = " ".join(map(str, fill_table(shards, size)))
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(packed), " ")).alias("slot", "shard"))
    names = F.array(*[F.lit(x) for x in shards])
    shard = F.col("shard").cast("int")
    return slots.select(F.col("slot").cast("long").alias("slot"), shard.alias("shard"), F.get(names, shard).alias("shard_name"))


def place(df: DataFrame, key: Column, fallback: Column | None = None, shards: list[str] | int = SHARDS,
          size: int = TABLE_SIZE, prefix: str = "") -> DataFrame:
    """``df`` with slot, shard and shard_name (named with ``prefix``, if the names clash with columns of ``df``)."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    new = {c: f"{prefix}{c}" for c in ("slot", "shard", "shard_name")}
    if clash := {c.lower() for c in df.columns} & {c.lower() for c in new.values()}:
        raise ValueError(f"columns {sorted(clash)} exist already; give a prefix")
    table = F.broadcast(table_frame(df.sparkSession, names, size)).withColumnsRenamed(new)
    full = F.coalesce(key.cast("string"), fallback.cast("string") if fallback is not None else F.lit(""), F.lit(""))
    return df.withColumn(new["slot"], slot_of(full, size)).join(table, new["slot"])
