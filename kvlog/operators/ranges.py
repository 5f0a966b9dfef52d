"""Key-range scans and range tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlog.operators.schema import Log

#: Tombstone fragments are broadcast up to this many; beyond, keys and fragments meet in buckets of the key space.
BROADCAST_FRAGMENTS = 100_000


def scan(df: DataFrame, key: str, lower=None, upper=None) -> DataFrame:
    """lower is inclusive, upper exclusive."""
    if lower is not None:
        df = df.where(F.col(key) >= lower)
    return df if upper is None else df.where(F.col(key) < upper)


def seek(df: DataFrame, key: str, target, n: int = 1) -> DataFrame:
    return df.where(F.col(key) >= target).orderBy(key).limit(n)


def seek_for_prev(df: DataFrame, key: str, target) -> DataFrame:
    return df.where(F.col(key) <= target).orderBy(F.desc(key)).limit(1)


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))


def fixed_prefix(key: Column, n: int) -> Column:
    """Null where the key is shorter: it is out of the transform's domain."""
    return F.when(F.length(key) >= n, F.substring(key, 1, n))


def capped_prefix(key: Column, n: int) -> Column:
    return F.substring(key, 1, n)


def _valid(tombstones: DataFrame) -> DataFrame:
    """Raises for a tombstone whose begin lies after its end, when it is read; an empty one (equal ends) covers nothing."""
    bad = F.col("begin") > F.col("end")
    return tombstones.withColumn("end", F.when(bad, F.raise_error(F.lit("range tombstone: begin is after end"))).otherwise(F.col("end")))


def fragments(tombstones: DataFrame, seq: int | None = None) -> DataFrame:
    """Non-overlapping (begin, end, seq): the newest tombstone that covers each stretch of the key space.

    A sweep per bucket of the key space: a tombstone goes to every bucket it reaches into, cut to it, so that no task sees
    all of them.  Bounds of buckets are begins of tombstones, so they cut no stretch that would be whole otherwise.
    """
    if seq is not None:
        tombstones = tombstones.where(F.col("seq") <= seq)
    tombstones = _valid(tombstones).where(F.col("begin") < F.col("end"))
    cells = _cut(tombstones, tombstones)
    ends = cells.select("cell", F.explode(F.array("begin", "end")).alias("begin")).distinct()
    stretch = ends.withColumn("end", F.lead("begin").over(Window.partitionBy("cell").orderBy("begin"))).where(F.col("end").isNotNull())
    t = cells.select("cell", F.col("begin").alias("tb"), F.col("end").alias("te"), "seq")
    over = stretch.join(t, "cell").where((F.col("tb") <= F.col("begin")) & (F.col("te") >= F.col("end")))
    return over.groupBy("begin", "end").agg(F.max("seq").alias("seq"))


#: Buckets of the key space.
CELLS = 64


def _bounds(tombstones: DataFrame) -> list:
    """At most CELLS - 1 begins that divide the key space, from a bounded sample; any orderable type."""
    some = tombstones.select(F.col("begin").alias("b")).distinct().orderBy(F.xxhash64("b"), "b").limit(CELLS * 16).orderBy("b").collect()
    step = max(1, len(some) // CELLS)
    return [r["b"] for r in some[step::step]][: CELLS - 1]


def _cell(key: Column, bounds: list) -> Column:
    out = F.lit(0)
    for b in bounds:
        out = out + (key >= F.lit(b)).cast("int")
    return out


def _cut(tombstones: DataFrame, of: DataFrame) -> DataFrame:
    """Tombstones with ``cell``, one row for each bucket they reach into, cut to its bounds."""
    bounds = _bounds(of)
    if not bounds:
        return tombstones.withColumn("cell", F.lit(0))
    # the end is exclusive: one that equals a bound doesn't reach into the bucket that begins there
    last = F.lit(0)
    for b in bounds:
        last = last + (F.col("end") > F.lit(b)).cast("int")
    ends = F.array(*[F.lit(b) for b in bounds])
    each = tombstones.withColumn("cell", F.explode(F.sequence(_cell(F.col("begin"), bounds), last)))
    low, high = F.get(ends, F.col("cell") - 1), F.get(ends, F.col("cell"))
    return each.withColumn("begin", F.greatest("begin", low)).withColumn("end", F.least("end", high))


def apply_tombstones(log: DataFrame, tombstones: DataFrame, d: Log, seq: int | None = None, within: tuple[str, Column] | None = None, broadcast_up_to: int = BROADCAST_FRAGMENTS) -> DataFrame:
    """Rows not covered: no visible tombstone has begin <= key < end and a sequence above the row's.

    within: (column of the log, expression over the tombstones) that must be equal, null-safe, for a tombstone to count.  Few
    tombstones are broadcast.  Beyond, only their non-overlapping fragments count (the newest sequence over each stretch),
    and keys meet them in buckets of the key space; keys of any orderable type.
    """
    key = d.key[0]
    if seq is not None:
        tombstones = tombstones.where(F.col("seq") <= seq)
        log = log.where(F.col(d.seq) <= seq)
    tombstones = _valid(tombstones)
    extra = F.lit(True)
    t = tombstones.select(F.col("begin").alias("_tb"), F.col("end").alias("_te"), F.col("seq").alias("_ts"), *([within[1].alias("_tw")] if within else []))
    if within:
        extra = F.col(within[0]).eqNullSafe(F.col("_tw"))
    covered = (F.col(key) >= F.col("_tb")) & (F.col(key) < F.col("_te")) & (F.col("_ts") > F.col(d.seq)) & extra
    if t.limit(broadcast_up_to + 1).count() <= broadcast_up_to:
        return log.join(F.broadcast(t), covered, "left_anti")
    bounds = _bounds(tombstones)
    cells = _cut(tombstones.withColumn("_tw", within[1] if within else F.lit(0)).where(F.col("begin") < F.col("end")), tombstones)
    cells = cells.select(F.col("begin").alias("_tb"), F.col("end").alias("_te"), F.col("seq").alias("_ts"), "_tw", F.col("cell").alias("_b"))
    return log.withColumn("_lb", _cell(F.col(key), bounds)).join(cells, (F.col("_lb") == F.col("_b")) & covered, "left_anti").drop("_lb")
