"""Wide-column rows: column updates with timestamps, TTL and tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity(value: Column, columns: Column | None = None) -> Column:
    """A row read as an entity: its wide columns; a plain value is one column without a name."""
    plain = F.create_map(F.lit(""), value)
    return plain if columns is None else F.coalesce(columns, plain)


def plain_value(value: Column, columns: Column) -> Column:
    """A row read as a plain value: of an entity, its column without a name."""
    return F.when(columns.isNull(), value).otherwise(F.try_element_at(columns, F.lit("")))


def column(entity_map: Column, name: str) -> Column:
    return F.try_element_at(entity_map, F.lit(name))


def merge_rows(updates: DataFrame, key: str, idx: str, ts: str, rest: list[str], row_tombstones: DataFrame | None = None) -> DataFrame:
    """Per (key, column) the update of the greatest timestamp; without columns at or before the row's tombstone (key, row_ts)."""
    out = updates.groupBy(key, idx).agg(F.max_by(F.struct(ts, *rest), ts).alias("_v")).select(key, idx, "_v.*")
    if row_tombstones is None:
        return out
    newest = row_tombstones.groupBy(key).agg(F.max("row_ts").alias("_row_ts"))
    return out.join(newest, key, "left").where(F.col("_row_ts").isNull() | (F.col(ts) > F.col("_row_ts"))).drop("_row_ts")


def expire(columns: Column, now: Column) -> Column:
    """Columns (kind, idx, ts, value, ttl): an expired one becomes a tombstone."""

    def one(c: Column) -> Column:
        gone = (c["kind"] == "expiring") & (c["ts"] + c["ttl"] < now)
        return F.struct(F.when(gone, "tombstone").otherwise(c["kind"]).alias("kind"), c["idx"].alias("idx"), c["ts"].alias("ts"), F.when(~gone, c["value"]).alias("value"), c["ttl"].alias("ttl"))

    return F.transform(columns, one)


def collect_tombstones(columns: Column, now: Column, grace: int) -> Column:
    """Without tombstones older than the grace period; for a full merge only."""
    return F.filter(columns, lambda c: ~((c["kind"] == "tombstone") & (c["ts"] + grace < now)))


def live_rows(columns: Column) -> Column:
    """Whether a row has any column left; one without goes at the next compaction."""
    return F.size(columns) > 0


def purge_expired(columns: Column, now: Column) -> Column:
    """Without expired columns, where they need not become tombstones."""
    return F.filter(columns, lambda c: ~((c["kind"] == "expiring") & (c["ts"] + c["ttl"] < now)))
