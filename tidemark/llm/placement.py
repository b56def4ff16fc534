"""Operator 8: constant-time shard placement from a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size, given
by an offset and a skip. The shards take turns: each claims its next preferred free slot,
until the table is full. A key hashes to a slot and the slot names the shard. When a shard
leaves, nearly all other slots keep their shard.

The table depends on the shards alone, has ``size`` entries whatever the input, and reaches
the executors as a broadcast of that size. Placement is DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 6553  # prime, over 100 slots for each of 64 shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _digest(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[15 * part : 15 * part + 15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard. Needs distinct shards and a prime size of at least their number."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)) or size < 2:
        raise ValueError("size must be a prime of at least the number of shards")
    offset = [_digest(s, 0) % size for s in shards]
    skip = [_digest(s, 1) % (size - 1) + 1 for s in shards]
    tried = [0] * len(shards)
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while True:
                slot = (offset[i] + tried[i] * skip[i]) % size
                tried[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            left -= 1
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 15 hex digits of the MD5 of its text, modulo size. A null key has slot 0."""
    digits = F.substring(F.md5(key.cast("string")), 1, 15)
    return F.coalesce(F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)), F.lit(0)).cast("int")


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard`` to each row.

    Equal keys go to one shard, so repeated rows stay together; a null key counts as slot 0.
    Columns of rows named slot or shard are replaced. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    table = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*map(F.lit, shards))
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "index"))
    slots = slots.select("slot", F.element_at(names, F.col("index").cast("int") + 1).alias("shard"))
    keyed = rows.withColumn("slot", slot_of(F.col(key), size)).drop("shard")
    return keyed.join(F.broadcast(slots), "slot", "left").select(*[f"`{c}`" for c in rows.columns if c.lower() not in ("slot", "shard")], "slot", "shard")
