"""Batches over a base: read-your-writes, commit checks, ingestion, change feed, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.operators.ordering import numbered
from kvlog.operators.schema import DELETE, Log


def overlay(base: DataFrame, delta: DataFrame, key: str, op: str = "op") -> DataFrame:
    """base with an uncommitted batch on top: the batch wins, its deletes hide."""
    kept = base.join(delta.select(key), key, "left_anti")
    return kept.unionByName(delta.where(F.col(op) != DELETE).select(*base.columns))


def conflicts(write_set: DataFrame, log: DataFrame, d: Log, snapshot: int) -> DataFrame:
    """Keys of the write set that something wrote after the snapshot."""
    return write_set.join(log.where(F.col(d.seq) > snapshot).select(*d.key), list(d.key), "left_semi")


def sequenced(batch: DataFrame, ordinal: str, first: int, seq: str = "seq") -> DataFrame:
    """A batch's operations with consecutive sequences in the order of ``ordinal``."""
    return numbered(batch, ordinal, alias=seq, start=first)


def ingest(log: DataFrame, external: DataFrame, seq: str, behind: bool = False) -> DataFrame:
    """External rows take one sequence above all others, or 0 where they are ingested behind."""
    top = F.lit(0).cast("long") if behind else F.lit((log.agg(F.max(seq)).first()[0] or 0) + 1).cast("long")
    return log.unionByName(external.withColumn(seq, top).select(*log.columns))


def changes_since(log: DataFrame, seq: str, start: int) -> DataFrame:
    """Changes from a sequence on, in order."""
    return log.where(F.col(seq) >= start).orderBy(seq)


def batches_since(log: DataFrame, seq: str, start: int, batch: str, *columns: str) -> DataFrame:
    """Changes from a sequence on, one row a batch: its first sequence and its operations in order.  A batch that begins
    before ``start`` comes whole if it reaches over it."""
    whole = log.groupBy(batch).agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.array_sort(F.collect_list(F.struct(seq, *columns))).alias("ops"))
    return whole.where(F.col("last") >= start).orderBy("first")


def batch_counts(batch: DataFrame, op: str) -> DataFrame:
    return batch.groupBy(op).agg(F.count(F.lit(1)).alias("n"))
