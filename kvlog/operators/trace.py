"""Reports over operation traces and block-access traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlog.operators.ordering import numbered, running_sum


def totals(trace: DataFrame, op: str, key: str, success: Column) -> DataFrame:
    return trace.groupBy(op).agg(F.count(F.lit(1)).alias("accesses"), F.countDistinct(key).alias("keys"), F.avg(success.cast("double")).alias("success"))


def key_stats(trace: DataFrame, key: str, more_than: int = 0) -> DataFrame:
    """Accesses of each key with a dense id in key order."""
    per = trace.groupBy(key).agg(F.count(F.lit(1)).alias("accesses"))
    return numbered(per, key, alias="key_id").where(F.col("accesses") > more_than)


def count_distribution(trace: DataFrame, key: str) -> DataFrame:
    return trace.groupBy(key).agg(F.count(F.lit(1)).alias("accesses")).groupBy("accesses").agg(F.count(F.lit(1)).alias("keys"))


def key_size_distribution(trace: DataFrame, key: str) -> DataFrame:
    return trace.select(F.col(key).cast("string").alias("k")).distinct().groupBy(F.length("k").alias("size")).agg(F.count(F.lit(1)).alias("keys"))


def value_size_distribution(trace: DataFrame, size: Column, interval: int = 8) -> DataFrame:
    return trace.groupBy(F.floor(size / interval).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rate(trace: DataFrame, ts: str, step: str = "hour") -> DataFrame:
    """Accesses of every step from the first to the last one, zeros included."""
    per = trace.groupBy(F.date_trunc(step, ts).cast("timestamp_ntz").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    ends = per.agg(F.min("at").alias("a"), F.max("at").alias("b")).where(F.col("a").isNotNull())
    every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {step}"))).alias("at"))
    return every.join(per, "at", "left").select("at", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rate_summary(trace: DataFrame, ts: str, step: str = "second") -> DataFrame:
    """Average and peak accesses a step; the average is over the whole steps between the first and the last access, 0 where
    there is none."""
    ends = trace.agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.count(F.lit(1)).alias("n"))
    peak = trace.groupBy(F.date_trunc(step, ts).alias("at")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("peak"))
    span = F.timestamp_diff(step.upper(), F.col("a"), F.col("b"))
    return ends.crossJoin(F.broadcast(peak)).select("n", F.when(span > 0, F.col("n") / span).otherwise(F.lit(0.0)).alias("average"), "peak")


def top_rates(trace: DataFrame, ts: str, k: int, step: str = "hour") -> DataFrame:
    return rate(trace, ts, step).orderBy(F.desc("n"), "at").limit(k)


def top_rate_prefixes(trace: DataFrame, ts: str, key: str, n: int, k: int, step: str = "hour") -> DataFrame:
    """Accesses by key prefix within the k busiest steps."""
    top = top_rates(trace, ts, k, step).select("at")
    own = trace.withColumn("at", F.date_trunc(step, ts).cast("timestamp_ntz")).join(F.broadcast(top), "at")
    return own.groupBy("at", F.substring(F.col(key).cast("string"), 1, n).alias("prefix")).agg(F.count(F.lit(1)).alias("accesses"))


def sample(trace: DataFrame, key: str, ratio: float) -> DataFrame:
    """About this share of the keys, each with all its accesses, the same ones in every run."""
    return trace.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("long") % 1_000_000 < int(ratio * 1_000_000))


def readable(trace: DataFrame, ts: str, op: str, key: str, size: Column) -> DataFrame:
    """One line an access: operation, hex key, value size, microseconds."""
    line = F.concat_ws(" ", F.col(op), F.hex(F.col(key).cast("string").cast("binary")), size.cast("string"), F.unix_micros(F.col(ts).cast("timestamp")).cast("string"))
    return trace.select(line.alias("line"))


def top_keys(trace: DataFrame, key: str, k: int) -> DataFrame:
    return trace.groupBy(key).agg(F.count(F.lit(1)).alias("accesses")).orderBy(F.desc("accesses"), key).limit(k)


def prefix_cut(trace: DataFrame, key: str, n: int, success: Column) -> DataFrame:
    p = F.substring(F.col(key).cast("string"), 1, n).alias("prefix")
    out = trace.groupBy(p).agg(F.count(F.lit(1)).alias("accesses"), F.countDistinct(key).alias("keys"), F.avg(success.cast("double")).alias("success"))
    return out.withColumn("mean", F.col("accesses") / F.col("keys"))


def pair_correlation(trace: DataFrame, key: str, order: str, op: str, first: str, second: str) -> DataFrame:
    """How often ``second`` follows ``first`` on the same key, and the mean gap in ``order`` to the last ``first``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = trace.where(F.col(op).isin(first, second)).withColumn("_a", F.last(F.when(F.col(op) == first, F.col(order)), True).over(w))
    return seen.where((F.col(op) == second) & F.col("_a").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(order) - F.col("_a")).alias("mean_gap"))


def correlation_matrix(trace: DataFrame, key: str, order: str, op: str, ops: list[str]) -> DataFrame:
    """For every pair of operations, how often ``second`` comes with some ``first`` before it on the same key, and the mean
    gap to the last one.  One pass: the last access of each kind is carried along."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = trace.where(F.col(op).isin(*ops)).select(key, order, op, *[F.last(F.when(F.col(op) == o, F.col(order)), True).over(w).alias(f"_{i}") for i, o in enumerate(ops)])
    each = seen.select(F.col(op).alias("second"), F.col(order).alias("_at"), F.explode(F.array(*[F.struct(F.lit(o).alias("first"), F.col(f"_{i}").alias("was")) for i, o in enumerate(ops)])).alias("p"))
    return each.where(F.col("p.was").isNotNull()).groupBy(F.col("p.first").alias("first"), "second").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_at") - F.col("p.was")).alias("mean_gap"))


def coverage(keyspace: DataFrame, trace: DataFrame, key: str) -> DataFrame:
    """Keys of the key space that were never accessed."""
    return keyspace.join(trace.select(key), key, "left_anti")


def unique_over_time(trace: DataFrame, key: str, ts: str, step: str = "hour") -> DataFrame:
    """Running number of distinct keys per step, carried through empty steps, and its share of the final number."""
    firsts = trace.groupBy(key).agg(F.min(ts).alias(ts))
    grown = running_sum(rate(firsts, ts, step), "n", "at", alias="keys")
    return grown.crossJoin(F.broadcast(grown.agg(F.max("keys").alias("_all")))).select("at", "keys", (F.col("keys") / F.col("_all")).alias("share"))


def histogram(trace: DataFrame, value: str, *by: str) -> DataFrame:
    """Exact percentiles: each group's distinct values are held by one task; see ``bucket_histogram`` for a bounded one."""
    p = lambda q: F.percentile(value, F.lit(q))
    return trace.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99")
    )


def bucket_limits(most: int = 2**62) -> list[int]:
    """Upper ends of the fixed buckets: 1, 2, then half as much again, rounded down to a power of ten while a tenth is over 10."""
    out, exact = [1, 2], 3.0
    while exact <= most:
        ten = 1
        while int(exact) // (10 * ten) > 10:
            ten *= 10
        out.append(int(exact) // ten * ten)
        exact *= 1.5
    return out


def bucket_histogram(trace: DataFrame, value: str, *by: str, percentiles: tuple[float, ...] = (50.0, 95.0, 99.0)) -> DataFrame:
    """Count, min, max, mean, standard deviation, and percentiles interpolated within fixed buckets, of whole numbers.

    A bucket holds values up to its limit and above the one before.  A group is at most as many rows as there are buckets
    after one combine, so memory is bounded whatever the values.  A percentile lies within the least and greatest value.
    """
    limits = bucket_limits()
    ends = F.array(*[F.lit(x).cast("long") for x in limits])
    v = F.col(value).cast("long")
    whole = lambda c: c.cast("decimal(38,0)")
    rows = trace.where(F.col(value).isNotNull()).select(*by, v.alias("_v"))
    place = F.lit(0)
    for x in limits[:-1]:
        place = place + (F.col("_v") > x).cast("int")
    per = rows.select(*by, "_v", place.alias("_b")).groupBy(*by, "_b")
    per = per.agg(F.count(F.lit(1)).alias("_n"), F.sum(whole(F.col("_v"))).alias("_s"), F.sum(whole(F.col("_v")) * F.col("_v")).alias("_q"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    all_ = per.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_s").cast("double").alias("_s"), F.sum("_q").cast("double").alias("_q"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.array_sort(F.collect_list(F.struct("_b", "_n"))).alias("_bs"))

    def at(p: float) -> Column:
        want = F.col("n") * (p / 100.0)
        # the first bucket whose running count reaches the share, and what came before it
        found = F.aggregate(
            "_bs",
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("b"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("own")),
            lambda a, x: F.when(a["b"] >= 0, a).otherwise(
                F.struct((a["sum"] + x["_n"]).alias("sum"), F.when(a["sum"] + x["_n"] >= want, x["_b"]).otherwise(-1).alias("b"), a["sum"].alias("before"), x["_n"].alias("own"))
            ),
        )
        low = F.when(found["b"] == 0, F.lit(0)).otherwise(F.get(ends, found["b"] - 1))
        high = F.get(ends, found["b"])
        inside = low + (high - low) * (want - found["before"]) / found["own"]
        return F.least(F.greatest(inside, F.col("lo")), F.col("hi")).cast("double")

    mean = F.col("_s") / F.col("n")
    sd = F.sqrt(F.greatest((F.col("_q") * F.col("n") - F.col("_s") * F.col("_s")) / (F.col("n") * F.col("n")), F.lit(0.0)))
    return all_.select(*by, "n", "lo", "hi", mean.alias("mean"), sd.alias("sd"), *[at(p).alias(f"p{p:g}") for p in percentiles])


def tickers(trace: DataFrame, ts: str, name: str, amount: Column, step: str = "hour") -> DataFrame:
    """Counters as a history: each counter's total at the end of every step in which it moved, and what it moved by."""
    per = trace.groupBy(F.col(name).alias("ticker"), F.date_trunc(step, ts).cast("timestamp_ntz").alias("at")).agg(F.sum(amount).alias("delta"))
    w = Window.partitionBy("ticker").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one row a step and counter
    return per.withColumn("total", F.sum("delta").over(w))


def ticker_deltas(history: DataFrame, total: str = "total") -> DataFrame:
    """The moves of counters whose totals were recorded: a total below the one before means that the counter was reset."""
    before = F.lag(total, 1, 0).over(Window.partitionBy("ticker").orderBy("at"))
    return history.withColumn("delta", F.when(F.col(total) < before, F.col(total)).otherwise(F.col(total) - before))


def reuse_interval(trace: DataFrame, block: str, ts: str, bucket: int) -> DataFrame:
    """Accesses by whole ``bucket`` seconds since the block's previous access."""
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(Window.partitionBy(block).orderBy(ts)), F.col(ts))
    return trace.withColumn("_gap", gap).where(F.col("_gap").isNotNull()).groupBy(F.floor(F.col("_gap") / bucket).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def lifetime(trace: DataFrame, block: str, ts: str) -> DataFrame:
    """Seconds from first to last access; null for a block accessed once."""
    per = trace.groupBy(block).agg(F.timestamp_diff("SECOND", F.min(ts), F.max(ts)).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.select(block, F.when(F.col("n") > 1, F.col("s")).alias("lifetime"))


def skew(trace: DataFrame, label: str, percents: tuple[int, ...]) -> DataFrame:
    """Share of all accesses of each slice of labels, from the hottest: slice p ends at rank floor(p * labels / 100)."""
    per = trace.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(per, F.desc("n"), label, alias="r", start=1).crossJoin(F.broadcast(per.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("total"))))
    which = F.lit(None).cast("int")
    for p in sorted(percents, reverse=True):
        which = F.when(F.col("r") <= F.floor(F.col("labels") * p / 100), F.lit(p)).otherwise(which)
    return ranked.withColumn("percent", which).where(F.col("percent").isNotNull()).groupBy("percent").agg((F.sum("n") / F.max("total")).alias("share"))


def timeline(trace: DataFrame, ts: str, label: str, step: str = "day") -> DataFrame:
    return trace.groupBy(F.date_trunc(step, ts).cast("timestamp_ntz").alias("at"), label).agg(F.count(F.lit(1)).alias("n"))


def percent_by(trace: DataFrame, label: str) -> DataFrame:
    per = trace.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def access_features(trace: DataFrame, block: str, ts: str, order: str) -> DataFrame:
    """Per access of a block: seconds since its last access, accesses of it so far, and seconds to its next access."""
    w = Window.partitionBy(block).orderBy(order)
    gap = lambda a, b: F.timestamp_diff("SECOND", a, b)
    return trace.select(
        block, order, gap(F.lag(ts).over(w), F.col(ts)).alias("since_last"), (F.row_number().over(w) - 1).cast("long").alias("accesses_before"), gap(F.col(ts), F.lead(ts).over(w)).alias("to_next")
    )


def feature_correlation(features: DataFrame, target: str, *columns: str) -> DataFrame:
    """Correlation of each feature with the target over the rows that have both."""
    return features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.col(target).cast("double").alias("y")) for c in columns])).alias("p")).select("p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("correlation"))


def reuse_timeline(trace: DataFrame, block: str, ts: str, step: str = "hour") -> DataFrame:
    """For each step in which blocks were first used, how many of them are used again so many steps later."""
    per = trace.select(F.col(block).alias("_b"), F.date_trunc(step, ts).cast("timestamp_ntz").alias("at")).distinct()
    first = per.groupBy("_b").agg(F.min("at").alias("first"))
    later = F.timestamp_diff(step.upper(), F.col("first"), F.col("at"))
    return per.join(first, "_b").groupBy("first", later.alias("later")).agg(F.count(F.lit(1)).alias("blocks"))


def block_stats(trace: DataFrame, block: str, size: str, *by: str) -> DataFrame:
    """Per label: blocks, and the histograms of accesses a block and of block size (the largest seen)."""
    per = trace.groupBy(*by, block).agg(F.count(F.lit(1)).alias("accesses"), F.max(size).alias("bytes"))
    named = lambda df, p: df.select(*by, F.col("n").alias("blocks"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in (*by, "n")])
    return named(bucket_histogram(per, "accesses", *by), "accesses").join(named(bucket_histogram(per, "bytes", *by), "bytes").drop("blocks"), list(by))


def io_summary(trace: DataFrame, op: str, file: str, latency: str, size: str) -> DataFrame:
    """Per file operation: calls, files, bytes, and the latency's histogram."""
    sums = trace.groupBy(op).agg(F.countDistinct(file).alias("files"), F.sum(size).alias("bytes"))
    return sums.join(bucket_histogram(trace, latency, op), op)


def miss_timeline(trace: DataFrame, ts: str, hit: Column, step: str = "hour") -> DataFrame:
    """Misses and miss ratio per step, by the hit flag of the trace."""
    per = trace.groupBy(F.date_trunc(step, ts).cast("timestamp_ntz").alias("at")).agg(F.count(F.lit(1)).alias("accesses"), F.sum((~hit).cast("long")).alias("misses"))
    return per.withColumn("ratio", F.col("misses") / F.col("accesses"))
