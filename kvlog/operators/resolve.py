"""Version resolution: what a reader of the log sees at a sequence or timestamp.

The newest version of a key is one ``max_by`` aggregate, combined before the shuffle; filters on key columns pass below it,
filters on values never do, so an old matching version can't stand in for a newer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlog.operators.schema import DELETE, SINGLE_DELETE, Log


def visible(log: DataFrame, d: Log, seq: int | None = None, ts=None) -> DataFrame:
    """Rows of a snapshot: sequence at most ``seq``, timestamp at most ``ts``."""
    if seq is not None:
        log = log.where(F.col(d.seq) <= seq)
    if ts is not None:
        log = log.where(F.col(d.ts) <= ts)
    return log


def latest(log: DataFrame, d: Log, seq: int | None = None, ts=None, deletes: bool = False) -> DataFrame:
    """The newest visible version of every key; keys whose newest version deletes them are left out unless ``deletes``."""
    order = F.struct(d.ts, d.seq) if ts is not None else F.col(d.seq)
    rest = [c for c in dict.fromkeys((d.seq, d.op, d.ts, *d.value)) if c and c not in d.key]
    out = visible(log, d, seq, ts).groupBy(*d.key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*d.key, "_v.*")
    if d.op and not deletes:
        out = out.where(~F.col(d.op).isin(DELETE, SINGLE_DELETE))
    return out


def history(log: DataFrame, d: Log, low, high) -> DataFrame:
    """All versions with a timestamp in [low, high], deletes included."""
    return log.where(F.col(d.ts).between(low, high))


def trim(log: DataFrame, d: Log, ts) -> DataFrame:
    return log.where(F.col(d.ts) <= ts)


def collapse_below(log: DataFrame, d: Log, low) -> DataFrame:
    """Every version at or after ``low`` and, of each key, the newest one before it."""
    old = log.where(F.col(d.ts) < low)
    newest = old.groupBy(*d.key).agg(F.max(d.seq).alias(d.seq))
    return log.where(F.col(d.ts) >= low).unionByName(old.join(newest, [*d.key, d.seq], "left_semi").select(*log.columns))


def multi_get(log: DataFrame, keys: DataFrame, d: Log, seq: int | None = None) -> DataFrame:
    """keys with their newest version and a status; the log is cut down to the keys before it is resolved."""
    found = latest(log.join(keys.select(*d.key).distinct(), list(d.key), "left_semi"), d, seq)
    status = F.when(F.col("_hit").isNull(), "not_found").otherwise("ok")
    return keys.join(found.withColumn("_hit", F.lit(1)), list(d.key), "left").withColumn("status", status).drop("_hit")


def key_may_exist(log: DataFrame, keys: DataFrame, d: Log) -> DataFrame:
    """The keys that have a version; exact, so stronger than a filter's answer."""
    return keys.join(log.select(*d.key), list(d.key), "left_semi")


def stripe_of(d: Log, snapshots: list[int]) -> Column:
    """The least snapshot at or above a row's sequence; null above all of them."""
    column = F.lit(None).cast("long")
    for s in sorted(snapshots, reverse=True):
        column = F.when(F.col(d.seq) <= s, F.lit(s).cast("long")).otherwise(column)
    return column


def stripes(log: DataFrame, d: Log, snapshots: list[int]) -> DataFrame:
    """The newest version of each key in each interval between snapshots: what compaction has to keep of puts and deletes."""
    rest = [c for c in log.columns if c not in d.key]
    striped = log.withColumn("stripe", stripe_of(d, snapshots))
    return striped.groupBy(*d.key, "stripe").agg(F.max_by(F.struct(*rest), d.seq).alias("_v")).select(*d.key, "stripe", "_v.*")


def cancel_single_deletes(log: DataFrame, d: Log) -> DataFrame:
    """Drops every single delete together with the put right before it."""
    w = Window.partitionBy(*d.key).orderBy(F.col(d.seq))
    marked = log.withColumn("_next", F.lead(d.op).over(w)).withColumn("_before", F.lag(d.op).over(w))
    put_gone = (F.col(d.op) == "put") & (F.coalesce("_next", F.lit("")) == SINGLE_DELETE)
    delete_done = (F.col(d.op) == SINGLE_DELETE) & (F.coalesce("_before", F.lit("")) == "put")
    return marked.where(~put_gone & ~delete_done).drop("_next", "_before")


def single_delete_violations(log: DataFrame, d: Log) -> DataFrame:
    """Keys that were put more than once since their last delete and then single-deleted."""
    w = Window.partitionBy(*d.key).orderBy(F.col(d.seq)).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.when(F.col(d.op).isin(DELETE, SINGLE_DELETE), F.col(d.seq))
    epoch = log.withColumn("_epoch", F.coalesce(F.max(gone).over(w), F.lit(-1)))
    return epoch.groupBy(*d.key, "_epoch").agg(F.sum((F.col(d.op) == "put").cast("long")).alias("puts"), F.max((F.col(d.op) == SINGLE_DELETE).cast("int")).alias("_sd")).where((F.col("puts") > 1) & (F.col("_sd") == 1)).select(*d.key, "puts")


def deletion_trigger(log: DataFrame, file: str, order: str, is_delete: Column, window: int, trigger: int) -> DataFrame:
    """Files in which some ``window`` consecutive entries hold at least ``trigger`` deletes."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(1 - window, 0)
    return log.withColumn("_d", F.sum(is_delete.cast("long")).over(w)).groupBy(file).agg(F.max("_d").alias("most_deletes")).withColumn("flagged", F.col("most_deletes") >= trigger)


def deletion_ratio(log: DataFrame, file: str, is_delete: Column, ratio: float) -> DataFrame:
    """Files whose deletes are at least this share of their entries."""
    return log.groupBy(file).agg(F.avg(is_delete.cast("double")).alias("ratio")).withColumn("flagged", F.col("ratio") >= ratio)
