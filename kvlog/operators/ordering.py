"""Numbers and running sums over a whole table's order, without a single task that sees all rows.

A bounded sample of the order's values gives bounds; rows between two bounds are a bucket, whose window is one task, and
buckets get the totals of those before them.  Equal values of the order are one bucket, so ties should be broken by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample that bounds are taken from, and buckets at most.
SAMPLE, BUCKETS = 2048, 64


def _parts(order: Column | str) -> tuple[Column, bool]:
    """The expression that is ordered by, and whether descending."""
    if isinstance(order, str):
        return F.col(order), False
    name = order._jc.toString()
    if name.endswith(" DESC NULLS LAST"):
        return F.col(name.removesuffix(" DESC NULLS LAST").strip("`")), True
    return order, False


def _after(columns: list[tuple[Column, bool]], bound: tuple) -> Column:
    """Whether a row comes after the bound in the order."""
    out = F.lit(False)
    for (c, down), v in reversed(list(zip(columns, bound, strict=True))):
        later = (c < F.lit(v)) if down else (c > F.lit(v))
        out = F.coalesce(later, F.lit(down)) | (c.eqNullSafe(F.lit(v)) & out) if v is not None else (c.isNotNull() if not down else F.lit(False)) | (c.isNull() & out)
    return out


def bucketed(df: DataFrame, *order: Column | str, buckets: int = BUCKETS) -> DataFrame:
    """df with ``_bucket``: rows of a lower bucket come before all rows of a higher one."""
    columns = [_parts(o) for o in order]
    keys = df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(columns)])
    names = keys.columns
    some = keys.orderBy(F.xxhash64(*names), *names).limit(SAMPLE)
    sorted_ = some.orderBy(*[F.desc(n) if down else F.asc(n) for n, (_, down) in zip(names, columns, strict=True)]).collect()
    step = max(1, len(sorted_) // buckets)
    bounds = list(dict.fromkeys(tuple(r) for r in sorted_[step::step]))[: buckets - 1]
    number = F.lit(0)
    for b in bounds:
        number = number + _after(columns, b).cast("int")
    return df.withColumn("_bucket", number)


def running_sum(df: DataFrame, value: str | None, *order: Column | str, alias: str = "running", buckets: int = BUCKETS) -> DataFrame:
    """df with the sum of ``value`` (the number of rows where it is None) over all rows up to this one in the order."""
    dealt = bucketed(df, *order, buckets=buckets)
    amount = F.lit(1) if value is None else F.col(value)
    totals = dealt.groupBy("_bucket").agg(F.sum(amount).alias("_total"))  # as many rows as buckets
    before = totals.select("_bucket", (F.sum("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")).alias("_before"))
    w = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.withColumn("_own", F.sum(amount).over(w)).join(F.broadcast(before), "_bucket")
    return joined.withColumn(alias, (F.col("_own") + F.col("_before")).cast("long" if value is None else dict(totals.dtypes)["_total"])).drop("_bucket", "_own", "_before")


def numbered(df: DataFrame, *order: Column | str, alias: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers from ``start`` in the order."""
    return running_sum(df, None, *order, alias=alias).withColumn(alias, F.col(alias) - 1 + start)
