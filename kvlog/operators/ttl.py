"""Values with a time of writing: reads that drop expired rows or don't, and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.operators.compact import expired
from kvlog.operators.merge import fold
from kvlog.operators.resolve import latest
from kvlog.operators.schema import Log


def read(log: DataFrame, d: Log, ttl: Column, now: Column, strict: bool = False) -> DataFrame:
    """The newest version of every key.  Expired ones are returned until a compaction drops them, unless ``strict``."""
    out = latest(log, d)
    return out.where(~expired(F.col(d.ts), ttl, now)) if strict else out


def merge(log: DataFrame, d: Log, name: str, ttl: Column | None = None, now: Column | None = None) -> DataFrame:
    """(key, value, ts): the fold without times of writing, which takes the newest of them; with ttl and now, expired rows are
    left out of the fold."""
    rows = log if ttl is None else log.where(~expired(F.col(d.ts), ttl, now))
    newest = rows.groupBy(*d.key).agg(F.max(d.ts).alias(d.ts))
    return fold(rows, d, name).join(newest, list(d.key))
