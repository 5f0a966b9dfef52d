"""Compaction as one job: stripes, tombstones, merge folds, filters, TTL; and eviction by age or size.

A *stripe* is the interval between two live snapshots; a reader at any of them sees the newest version of a key in its
stripe or below.  So of each (key, stripe) there stay: the merge operands above the newest put or delete, and that one.
Range tombstones hide rows of their own stripe alone; what lies below an older snapshot must stay readable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.operators.merge import FOLDS
from kvlog.operators.ordering import running_sum
from kvlog.operators.ranges import apply_tombstones
from kvlog.operators.resolve import stripe_of
from kvlog.operators.schema import DELETE, MERGE, PUT, SINGLE_DELETE, Log

#: Decisions of a compaction filter (``decide``).
KEEP, REMOVE, CHANGE_VALUE, SKIP_UNTIL, PURGE = "keep", "remove", "change_value", "remove_and_skip_until", "purge"


def expired(ts: Column, ttl: Column, now: Column) -> Column:
    """write time + ttl < now; a null or non-positive ttl never expires."""
    return F.coalesce((ttl > 0) & (ts + ttl < now), F.lit(False))


def compact(
    log: DataFrame,
    d: Log,
    drop: Column | None = None,
    tombstones: DataFrame | None = None,
    snapshots: tuple[int, ...] = (),
    bottom: bool = True,
    fold: str | None = None,
    drop_operand: Column | None = None,
    decide: Callable[[DataFrame], tuple[Column, Column | None, Column | None]] | None = None,
) -> DataFrame:
    """What a rewrite of the whole log keeps, with the log's columns.

    drop marks values to leave out, drop_operand merge operands (before they are folded).  fold names a merge operator: operands
    over a put or delete of their stripe become one put, as do operands over nothing in the lowest stripe of a bottom
    rewrite; others stay as operands.  decide gives (decision, new value, skip_until) of the newest value of a key: a removed
    one becomes a delete, so that it still hides what older stripes have; purge leaves nothing behind; skip_until also
    removes every key from this one up to the given key.  On the bottom level deletes that no snapshot needs go.
    """
    names, value = log.columns, d.value[0] if d.value else None
    op = F.col(d.op) if d.op else F.lit(PUT)
    rows = log.withColumn("_stripe", stripe_of(d, list(snapshots)))
    if tombstones is not None:
        rows = apply_tombstones(rows, tombstones, d, within=("_stripe", stripe_of(Log(key=(), seq="seq"), list(snapshots))))
    if drop_operand is not None and d.op:
        rows = rows.where((op != MERGE) | ~F.coalesce(drop_operand, F.lit(False)))
    group = [*d.key, "_stripe"]
    base = rows.groupBy(*group).agg(F.max(F.when(op != MERGE, F.col(d.seq))).alias("_base"), F.max(d.seq).alias("_top"))
    joined = rows.alias("l").join(base.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]).select("l.*", "_base", "_top")
    kept = joined.where(F.col("_base").isNull() | (F.col(d.seq) >= F.col("_base")))
    if fold and d.op:
        kept = _folded(kept, d, value, fold, group, bottom)
    if decide is not None or drop is not None:
        newest = kept.groupBy(*d.key).agg(F.max(d.seq).alias("_newest"))
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in d.key]
        kept = kept.alias("l").join(newest.alias("r"), on).select("l.*", (F.col("_newest") == F.col(f"l.{d.seq}")).alias("_first"))
    is_put = (F.col(d.op) == PUT) if d.op else F.lit(True)
    if drop is not None:
        gone = is_put & F.coalesce(drop, F.lit(False)) & F.col("_first")
        kept = _removed(kept, d, gone)
    if decide is not None:
        decision, changed, until = decide(kept)
        kept = kept.withColumn("_decision", F.when(is_put & F.col("_first"), F.coalesce(decision, F.lit(KEEP))).otherwise(KEEP))
        if until is not None:
            skips = kept.where(F.col("_decision") == SKIP_UNTIL).select(F.col(d.key[0]).alias("begin"), until.alias("end"), F.lit(2**62).alias("seq"))
            kept = apply_tombstones(kept, skips, d)
        if changed is not None:
            kept = kept.withColumn(value, F.when(F.col("_decision") == CHANGE_VALUE, changed).otherwise(F.col(value)))
        kept = kept.where(F.col("_decision") != PURGE)
        kept = _removed(kept, d, F.col("_decision") == REMOVE)
    if d.op and bottom:
        lowest = F.col("_stripe").eqNullSafe(F.lit(min(snapshots)) if snapshots else F.lit(None))
        kept = kept.where(~(F.col(d.op).isin(DELETE, SINGLE_DELETE) & lowest))
    return kept.select(*names)


def _removed(rows: DataFrame, d: Log, gone: Column) -> DataFrame:
    """The marked rows as deletes without values; gone altogether where the log has no operations."""
    if not d.op:
        return rows.where(~gone)
    rows = rows.withColumn("_gone", gone)
    own = {**{c: F.when(~F.col("_gone"), F.col(c)) for c in d.value}, d.op: F.when(F.col("_gone"), DELETE).otherwise(F.col(d.op))}
    return rows.withColumns(own).drop("_gone")


def _folded(rows: DataFrame, d: Log, value: str, fold: str, group: list[str], bottom: bool) -> DataFrame:
    """Rows down to each group's base, with the operands over it folded; rows carry _base and _top."""
    is_merge = F.col(d.op) == MERGE
    single = F.col("_base").isNotNull() & (F.col("_base") == F.col("_top"))
    rest = rows.where(single)
    chains = rows.where(~single)
    low = rows.groupBy(*d.key).agg(F.min(F.coalesce("_stripe", F.lit(2**62))).alias("_low"))
    chains = chains.alias("l").join(low.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in d.key]).select("l.*", "_low")
    ends = F.col("_base").isNotNull() | (F.lit(bottom) & (F.coalesce("_stripe", F.lit(2**62)) == F.col("_low")))
    open_ = chains.where(~ends).drop("_low")
    ops = F.transform(F.array_sort(F.collect_list(F.when(is_merge, F.struct(F.col(d.seq).alias("s"), F.col(value).alias("v"))))), lambda x: x["v"])
    start = F.max(F.when(F.col(d.op) == PUT, F.struct(F.col(d.seq), F.col(value).alias("v"))))["v"]
    done = chains.where(ends).groupBy(*group).agg(F.max("_top").alias(d.seq), start.alias("_start"), ops.alias("_ops"), F.first("_base").alias("_base"), F.max("_top").alias("_top"))
    kind = dict(rows.dtypes)
    own = {**{c: F.col(c) for c in (*group, d.seq, "_base", "_top")}, d.op: F.lit(PUT), value: FOLDS[fold](F.col("_start"), F.col("_ops")).cast(kind[value])}
    made = done.select(*[own.get(c, F.lit(None).cast(kind[c])).alias(c) for c in rows.columns])
    return rest.unionByName(open_).unionByName(made)


def evict_oldest(files: DataFrame, size: str, order: str, limit: int) -> DataFrame:
    """Newest files first until ``limit`` bytes are reached; the rest goes."""
    return running_sum(files, size, F.desc(order), alias="running").where(F.col("running") <= limit)


def evict_by_age(files: DataFrame, created: str, now: Column, ttl: int) -> DataFrame:
    """Files younger than ``ttl``; 0 keeps all."""
    return files.where(~expired(F.col(created), F.lit(ttl), now)) if ttl > 0 else files
