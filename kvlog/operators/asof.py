"""As-of joins and ordered merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlog.operators.ordering import bucketed


def asof_join(left: DataFrame, log: DataFrame, key: str, left_at: str, log_at: str, value: list[str], slices: int = 32, tie: str | None = None) -> DataFrame:
    """left with the ``value`` columns of the newest row of log of the same key with log_at <= left_at; null where there is none.

    One pass over the union of both in order, no pairs.  A key is cut in slices of time, so that a hot one is many tasks: a
    slice's rows see its own log rows, else the newest of the earlier slices, which is one row a slice.  Null keys match
    nothing.  tie: a column of log that orders rows of one time.
    """
    own = [c for c in left.columns]
    rows = left.select(F.struct(*own).alias("_left"), F.col(key).alias("_key"), F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(log.dtypes)[tie] if tie else "int").alias("_tie"))
    facts = log.where(F.col(key).isNotNull()).select(F.struct(*value).alias("_v"), F.col(key).alias("_key"), F.col(log_at).alias("_at"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    both = bucketed(rows.unionByName(facts, allowMissingColumns=True), "_at", buckets=slices)
    order = ["_at", "_side", "_tie"]
    within = Window.partitionBy("_key", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_near", F.last("_v", True).over(within))
    ends = both.where("_side = 0").groupBy("_key", "_bucket").agg(F.max_by("_v", F.struct("_at", "_tie")).alias("_end"))
    # a slice of a key gets the newest end before it: as many rows as slices that have some
    slots = seen.where("_side = 1").select("_key", "_bucket").distinct().join(ends, ["_key", "_bucket"], "full")
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("_key", "_bucket", F.last("_end", True).over(earlier).alias("_carried"))
    on = [F.col("s._key").eqNullSafe(F.col("c._key")), F.col("s._bucket") == F.col("c._bucket")]
    out = seen.where("_side = 1").alias("s").join(carried.alias("c"), on, "left").select("_left", "s._key", F.coalesce("_near", "_carried").alias("_v"))
    return out.select("_left.*", *[F.when(F.col("_key").isNotNull(), F.col(f"_v.{c}")).alias(c) for c in value])


def merge_ordered(runs: list[DataFrame], *keys: str) -> DataFrame:
    """Sorted runs as one sorted table."""
    return merge_unordered(runs).orderBy(*keys)


def merge_unordered(runs: list[DataFrame]) -> DataFrame:
    """Runs one after the other, without an order."""
    return reduce(DataFrame.unionByName, runs)
