"""Streams over a log directory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvlog.operators.compact import compact
from kvlog.operators.schema import Log
from kvlog.sources.archive import delete, exists, tables
from kvlog.sources.package import give


def changes(spark: SparkSession, path: str, schema, seq: str, start: int = 0, files_per_trigger: int | None = None) -> DataFrame:
    """Rows with a sequence of at least ``start``, as files of the log arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).where(F.col(seq) >= start)


def newest_by_key(feed: DataFrame, d: Log) -> DataFrame:
    """Streaming state: the newest version of each key; a lower sequence that arrives later never wins."""
    rest = [c for c in dict.fromkeys((d.seq, d.op, d.ts, *d.value)) if c and c not in d.key]
    return feed.groupBy(*d.key).agg(F.max_by(F.struct(*rest), d.seq).alias("_v")).select(*d.key, "_v.*")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that are written whole."""
    return sorted(int(n[2:]) for n in tables(spark, path) if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS")) if exists(spark, path) else []


def compact_into(feed: DataFrame, d: Log, path: str, checkpoint: str, fold: str | None = None, every: int = 8, keep: int = 2) -> StreamingQuery:
    """A follower that keeps a compacted copy in ``path``.

    Each batch is appended as a run ``r=<batch>``; every so many batches the runs and the newest version are compacted (merge
    operands folded by ``fold``) into ``v=<batch>``, after which runs it covers and all but ``keep`` versions are deleted.  A
    batch that is run again rewrites its own run, and its version unless that is written whole, so nothing counts twice and
    nothing is lost.  With ``fold``, sequences must arrive in order, as a log's do; without, late rows count as if in time.
    ``follower`` reads the state.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/runs/r={n}")
        if (n + 1) % every:
            return
        whole = _versions(spark, path)
        done = [v for v in whole if v < n]
        runs = [k for k in sorted(int(x[2:]) for x in tables(spark, f"{path}/runs")) if k <= n]
        if n not in whole:
            rows = spark.read.parquet(*[f"{path}/runs/r={k}" for k in runs if not done or k > done[-1]])
            if done:
                rows = spark.read.parquet(f"{path}/v={done[-1]}").unionByName(rows, allowMissingColumns=True)
            compact(rows, d, fold=fold, bottom=False).write.mode("overwrite").parquet(f"{path}/v={n}")
        for k in runs:
            delete(spark, f"{path}/runs/r={k}")
        for v in done[: max(0, len(done) + 1 - keep)]:
            delete(spark, f"{path}/v={v}")

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follower(spark: SparkSession, path: str) -> DataFrame:
    """The log that ``compact_into`` has so far: its newest version and the runs since."""
    versions = _versions(spark, path)
    runs = [int(x[2:]) for x in tables(spark, f"{path}/runs")] if exists(spark, f"{path}/runs") else []
    parts = [f"{path}/v={versions[-1]}"] if versions else []
    parts += [f"{path}/runs/r={k}" for k in sorted(runs) if not versions or k > versions[-1]]
    out = spark.read.parquet(parts[0])
    for p in parts[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def rates(feed: DataFrame, ts: str, window: str, delay: str, *by: str) -> DataFrame:
    """Counts per time window and label; late rows are waited for as long as ``delay``."""
    return feed.withWatermark(ts, delay).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n"))


def stats(feed: DataFrame, ts: str, value: str, window: str, delay: str) -> DataFrame:
    """Count, sum, least and greatest value per time window: a history of statistics."""
    return feed.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.col("w.start").alias("at"), "n", "sum", "lo", "hi")


def live(feed: DataFrame, d: Log, schema: str, ttl_seconds: int) -> DataFrame:
    """The newest version of each key as it changes, and a row with ``expired`` once event time has passed its time of writing by
    the ttl; a later version starts anew.  schema: the DDL of the columns key, ts, seq, values, as in the log."""
    names = [*d.key, d.ts, d.seq, *d.value]
    state = "seq long, ts timestamp"

    def step(key, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            row = {n: [None] for n in names} | dict(zip(d.key, ([k] for k in key), strict=True)) | {"expired": [True]}
            yield pd.DataFrame(row)
            return
        best = None
        for f in frames:
            top = f.loc[f[d.seq].idxmax()]
            best = top if best is None or top[d.seq] > best[d.seq] else best
        if best is None or (kept.exists and kept.get[0] >= best[d.seq]):
            return
        kept.update((int(best[d.seq]), best[d.ts]))
        ends = int(best[d.ts].timestamp() * 1000) + ttl_seconds * 1000
        if ends > kept.getCurrentWatermarkMs():
            kept.setTimeoutTimestamp(ends)
        yield pd.DataFrame([{n: best[n] for n in names} | {"expired": False}])

    give(feed.sparkSession)
    rows = feed.select(*names).withWatermark(d.ts, "0 seconds")
    return rows.groupBy(*d.key).applyInPandasWithState(step, f"{schema}, expired boolean", state, "append", GroupStateTimeout.EventTimeTimeout)
