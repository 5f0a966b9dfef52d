"""Sharding by a permutation-filled lookup table; DataFrame functions only on the rows' path.

Every shard has its own permutation of the slots of a prime-sized table (offset and skip from a hash of its name); shards
take turns claiming their next free slot until the table is full.  The table's size is a parameter (``SLOTS`` rows of
two integers, about 1 MB), so it can always be broadcast; a row is placed by one lookup of hash(key) mod size.
Removing a shard moves its own rows and few others.

Defined cases: a null key is placed as the empty text; equal keys go to one shard whatever their number (each row costs
one lookup, nothing is shuffled); an empty table stays empty; with ``weights`` a shard takes that many turns a round, none
with 0, and at least one must take some; other columns stay, whatever their names, but an input column that has the name
of the result's is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.llm.common import packed, table

SLOTS = 65537
SHARDS = 64


def fill(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """Index of the shard that owns each slot."""
    if not shards or slots < len(shards):
        raise ValueError("at least one shard, and no fewer slots than shards")
    if any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    turns = [(weights or {}).get(name, 1) for name in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights are 0 or more, and one at least is more")
    at, skip = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % slots)
        skip.append(int.from_bytes(h[8:16], "big") % (slots - 1) + 1)
    owner, free = [-1] * slots, slots
    while True:
        for i, n in enumerate(turns):
            for _ in range(n):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
                if not free:
                    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def lookup(spark: SparkSession, owner: list[int]) -> DataFrame:
    """(slot, shard)"""
    text = F.lit(",".join(map(str, owner)))
    return spark.range(1).select(F.posexplode(F.split(text, ",").cast("array<int>")).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), "shard")


def shard(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None, column: str = "shard") -> DataFrame:
    """rows with the index of their shard in ``column``."""
    places = lookup(rows.sparkSession, fill(shards, slots, weights))
    placed = packed(rows).withColumn("slot", slot_of(F.col("row").getField(key), slots)).join(F.broadcast(places), "slot")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in rows.columns if c != column], F.col("shard").alias(column))


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", slot_of(F.col("doc_id")).alias("slot"))
    return shard(docs, "doc_id", names()).select("doc_id", "slot", "shard")


def op1_sql() -> str:
    """The table's rows come as a list; how it is filled is tested on its own."""
    owner = ",".join(map(str, fill(names())))
    slot = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS}"
    return f"SELECT doc_id, {slot} AS slot, (SELECT CAST('[{owner}]' AS INTEGER[]))[CAST({slot} AS INTEGER) + 1] AS shard FROM documents"
