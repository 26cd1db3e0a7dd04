"""Placement of rows on shards by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own order of preference over the slots of a prime-sized table (an offset and a
step, from digests of its name). The shards take turns, each claiming its next free slot, until the
table is full: shares differ by one slot at most, and most slots keep their shard when one is added or
removed. The table has a fixed size and is broadcast; a row's slot is a digest of its key.

Null keys count as one key of their own; equal keys share a shard, as they must. Empty tables give
empty results. Rows keep all their columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, well over a hundred times the shards expected.
SLOTS = 65537


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard, as its place in ``shards``, of each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shard names must be distinct, at least one and no more than the slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    wish = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while owner[wish[shard]] >= 0:
                wish[shard] = (wish[shard] + step[shard]) % slots
            owner[wish[shard]] = shard
            free -= 1
            if not free:
                return owner


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``: the table as rows, from literals."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    names = F.array(*map(F.lit, shards))
    listed = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return listed.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Sixty bits of the key's md5, modulo the slots."""
    digest = F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(rows: DataFrame, key_col: str, shards: Sequence[str], *, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``rows`` with their slot and shard."""
    kept = [c for c in rows.columns if c not in (slot_col, shard_col)]
    placed = rows.select(F.struct(*kept).alias("row"), slot_of(F.col(key_col), slots).alias("at"))
    # ``slots`` rows, whatever the data
    table = F.broadcast(table_frame(rows.sparkSession, shards, slots))
    joined = placed.join(table, F.col("at") == F.col("slot"))
    return joined.select("row.*", F.col("at").alias(slot_col), F.col("shard").alias(shard_col))


def write_shards(rows: DataFrame, path: str, key_col: str, shards: Sequence[str], *, pieces: int = 1, rows_per_file: int = 1_000_000) -> None:
    """One folder per shard. A shard is written by ``pieces`` tasks, so that a hot one is not one task."""
    placed = assign_shards(rows, key_col, shards)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(pieces))
    placed.repartition(F.col("shard"), salt).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
