"""Sharding by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table. The
shards take turns, each claiming the first slot of its walk that is still
free, until the table is full. A row is placed by hashing its key to a slot,
so placement is one lookup in a table of fixed size, shards differ by at most
one slot, and adding or removing a shard moves few slots between the others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime, and over a hundred slots for each of the query's shards.
TABLE_SIZE = 16381
SHARDS = 128


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The table: slot -> position of its shard in ``shards``.

    ``size`` must be prime so that every step width visits all slots. Work and
    memory depend on the two arguments only, never on the data. Names must be
    distinct; an empty list is an error.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    at, step = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1 if size > 1 else 0)
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table's size. Null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` int and ``shard`` string to every row.

    Rows are kept as they are; equal keys, nulls included, meet in one shard.
    Columns already named slot or shard are replaced. Nothing is shuffled: the
    table has exactly ``size`` rows, which bounds what is broadcast.
    """
    spark = df.sparkSession
    table = fill(shards, size)
    lookup = spark.range(1).select(
        F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("__slot", "k")).select(
        "__slot", F.element_at(F.array(*map(F.lit, shards)), F.col("k").cast("int") + 1).alias("shard"))
    names = [c for c in df.columns if c not in ("slot", "shard")]
    rows = df.select(*names, slot_of(F.col(key), size).alias("slot"))
    return rows.join(F.broadcast(lookup), F.col("slot") == F.col("__slot"), "left").select(*names, "slot", "shard")


def write_sharded(df: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE, splits: int = 8) -> None:
    """Write one folder per shard. Each shard is dealt over ``splits`` tasks by slot."""
    placed = place(df, key, shards, size)
    placed.repartition(len(shards) * splits, "shard", F.pmod(F.col("slot"), F.lit(splits))).write.partitionBy("shard").parquet(path)
