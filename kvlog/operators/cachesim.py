"""Cache simulation over block-access traces.

With one shard, as the registered queries have it, the replay is exact for a single cache: one task replays the whole trace of a
capacity in order, batch by batch, and holds the cache alone.  With more, each (capacity, shard) replays the accesses of its
blocks with its share of the capacity: a model of a cache sharded by block hash, whose misses differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlog.operators.caches import POLICIES
from kvlog.sources.package import give


def misses(blocks: list, sizes: list[int], capacity: int, policy: str, labels: list[str] | None = None) -> int:
    """Misses of one replay."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    cache = POLICIES[policy](capacity)
    due: list[int | None] = [None] * len(blocks)
    last: dict = {}
    for i in range(len(blocks) - 1, -1, -1):
        due[i] = last.get(blocks[i])
        last[blocks[i]] = i
    return sum(not cache.access(b, s, d, labels[i] if labels else "") for i, (b, s, d) in enumerate(zip(blocks, sizes, due, strict=True)))


def replay(trace: DataFrame, block: str, size: str, order: str, capacities: list[int], policy: str = "lru", shards: int = 1, label: str | None = None, every: int | None = None) -> DataFrame:
    """(capacity, step, accesses, misses): step is the order divided by ``every`` (null where that is None)."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    give(trace.sparkSession)
    name = F.col(block).cast("string")
    rows = trace.select(name.alias("block"), F.col(size).cast("long").alias("size"), F.col(order).cast("long").alias("at"), (F.col(label) if label else F.lit("")).cast("string").alias("label"))
    due = F.lead("at").over(Window.partitionBy("block").orderBy("at")) if policy == "opt" else F.lit(None).cast("long")
    rows = rows.withColumn("due", due).withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("long")).withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("long") for c in capacities])))
    dealt = rows.repartition(max(len(capacities) * shards, 1), "capacity", "shard").sortWithinPartitions("capacity", "shard", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cache, step, n, missed = None, None, None, 0, 0
        out: list[tuple] = []
        for batch in batches:
            for b, s, place, lab, nxt, shard, capacity in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = None if every is None else place // every
                if (capacity, shard) != at or now != step:
                    if at is not None:
                        out.append((at[0], step, n, missed))
                    n = missed = 0
                    step = now
                    if (capacity, shard) != at:
                        at, cache = (capacity, shard), POLICIES[policy](max(1, capacity // shards))
                n += 1
                missed += not cache.access(b, s or 0, nxt, lab or "")
        if at is not None:
            out.append((at[0], step, n, missed))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["capacity", "step", "accesses", "misses"])

    return dealt.mapInArrow(run, "capacity long, step long, accesses long, misses long").groupBy("capacity", "step").agg(F.sum("accesses").alias("accesses"), F.sum("misses").alias("misses"))


def simulate(trace: DataFrame, block: str, size: str, order: str, capacities: list[int], policy: str = "lru", shards: int = 1, label: str | None = None) -> DataFrame:
    """(capacity, accesses, misses, miss_ratio): a miss-ratio curve."""
    return replay(trace, block, size, order, capacities, policy, shards, label).drop("step").withColumn("miss_ratio", F.col("misses") / F.col("accesses"))


def reuse_distances(trace: DataFrame, block: str, size: str, order: str, by: str) -> DataFrame:
    """Bytes of distinct blocks between consecutive accesses of a block, within each label ``by``; null for the first.

    A label is one task, which holds its accesses' sizes (a tree of 8 bytes each)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at", kind="stable").reset_index(drop=True)
        n = len(part)
        tree = [0] * (n + 1)

        def add(i: int, v: int) -> None:
            i += 1
            while i <= n:
                tree[i] += v
                i += i & -i

        def upto(i: int) -> int:
            s = 0
            while i > 0:
                s += tree[i]
                i -= i & -i
            return s

        last: dict = {}
        out = []
        for i, (b, s) in enumerate(zip(part["block"], part["size"], strict=True)):
            if b in last:
                j, was = last[b]
                out.append(upto(i) - upto(j + 1))
                add(j, -was)
            else:
                out.append(None)
            add(i, int(s))
            last[b] = (i, int(s))
        return pd.DataFrame({"label": part["label"], "at": part["at"], "distance": pd.array(out, dtype="Int64")})

    give(trace.sparkSession)
    rows = trace.select(F.col(by).cast("string").alias("label"), F.col(block).cast("string").alias("block"), F.col(size).cast("long").alias("size"), F.col(order).cast("long").alias("at"))
    return rows.groupBy("label").applyInPandas(one, "label string, at long, distance long")
