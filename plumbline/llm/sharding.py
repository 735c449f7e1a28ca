"""Placement of keys on shards by a permutation-filled lookup table (Maglev hashing, Eisenbud et al., 2016)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: a prime, at least a hundred for each shard, so that shares differ by about one per cent at most.
SLOTS = 4099


def _number(text: str, at: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[at : at + 8], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's position in ``shards`` for each slot.

    Each shard has a preference order of slots, ``(offset + j * skip) mod slots``; shards claim
    their next free preferred slot in turn until none is left.  ``slots`` must be prime, so that
    each order is a permutation.  No shard, or repeated names, raise ValueError.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and each once")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    offset = [_number(s, 0) % slots for s in shards]
    skip = [_number(s, 8) % (slots - 1) + 1 for s in shards]
    turn, out, left = [0] * len(shards), [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while out[c := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            out[c] = i
            left -= 1
            if not left:
                break
    return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of the MD5 of its text, modulo ``slots``; null counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` for each row, replacing columns of those names.

    The table is a literal of ``slots`` integers in the plan, so it reaches each task with the
    code, its size is fixed by the parameter, and a row costs one hash and one array access: no
    shuffle.  Rows with equal keys go together; rows with a null key go where empty text goes.
    An empty table gives an empty table.
    """
    table, names = F.lit(lookup_table(shards, slots)), F.lit(list(shards))
    df = df.withColumn("slot", slot_of(F.col(key), slots))
    return df.withColumn("shard", F.element_at(names, F.element_at(table, F.col("slot") + 1) + 1))


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, tasks_per_shard: int = 8) -> None:
    """Writes one folder per shard.  A shard's rows are dealt over ``tasks_per_shard`` tasks by a
    second hash of the key, so that neither a heavy shard nor a heavy key's neighbours meet in one."""
    placed = place(df, key, shards)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(tasks_per_shard))
    placed.repartition("shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)


def shares(df: DataFrame) -> DataFrame:
    """Rows per shard of a placed table."""
    return df.groupBy("shard").agg(F.count("*").alias("n"))
