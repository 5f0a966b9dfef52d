"""Command line over a log folder: ``python -m kvlog.cli --db FOLDER VERB ...``.

A log is Parquet with key, seq, op, value (text), and end for range deletes.  Writing verbs append; rows go to standard output.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.operators import merge, ranges, writes
from kvlog.operators.compact import compact
from kvlog.operators.schema import Log
from kvlog.sources import archive, layout

LOG = Log(key=("key",), seq="seq", value=("value",), op="op")
SCHEMA = "key string, seq long, op string, value string, end string"


def session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def load(spark: SparkSession, db: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{db}/log") if archive.exists(spark, f"{db}/log") else spark.createDataFrame([], SCHEMA)


def append(spark: SparkSession, db: str, batch: writes.WriteBatch) -> None:
    log = load(spark, db)
    first = (log.agg(F.max("seq")).first()[0] or 0) + 1
    rows = [(key, first + ordinal, op, value, end) for ordinal, op, key, end, value, _ in batch.rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{db}/log")


def visible(log: DataFrame, fold: str, seq: int | None = None) -> DataFrame:
    """(key, value) as a reader sees them."""
    points, tombs = writes.split_log(log)
    return merge.fold(ranges.apply_tombstones(points, tombs, LOG, seq), LOG, fold, seq)


def show(df: DataFrame, out, limit: int | None = None) -> int:
    n = 0
    for r in (df if limit is None else df.limit(limit)).toLocalIterator():
        out.write("\t".join("" if v is None else str(v) for v in r) + "\n")
        n += 1
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kvlog")
    p.add_argument("--db", required=True)
    p.add_argument("--merge-operator", default="append")
    v = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options) -> argparse.ArgumentParser:
        q = v.add_parser(name)
        for a in args:
            q.add_argument(a)
        for a, kind in options.items():
            q.add_argument("--" + a, dest=a, type=kind)
        return q

    verb("get", "key", seq=int)
    verb("put", "key", "value")
    verb("merge", "key", "value")
    verb("delete", "key")
    verb("singledelete", "key")
    verb("deleterange", "begin", "end")
    verb("batchput").add_argument("pairs", nargs="+")
    verb("scan", **{"from": str, "to": str, "max_keys": int, "seq": int})
    verb("dump", **{"from": str, "to": str, "max_keys": int, "seq": int})
    verb("query", "sql")
    verb("idump", max_keys=int)
    verb("dump_wal", since=int)
    verb("approxsize", **{"from": str, "to": str})
    verb("list_file_range_deletes")
    verb("list_tables")
    verb("list_live_files_metadata")
    verb("file_checksum_dump")
    verb("checkconsistency")
    verb("get_property", "name")
    verb("compact")
    verb("checkpoint", "path", seq=int)
    verb("backup", "path")
    verb("restore", "path", version=int)
    verb("dump_table", "path")
    verb("load", "path")
    verb("write_extern_sst", "path")
    verb("ingest_extern_sst", "path")
    return p


def main(args: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(args)
    spark = spark or session()
    log = load(spark, a.db)
    batch = writes.WriteBatch(a.merge_operator)
    kv = lambda seq=None: visible(log, a.merge_operator, seq)
    if a.verb == "get":
        return 0 if show(kv(a.seq).where(F.col("key") == a.key).select("value"), out) else 1
    elif a.verb == "put":
        append(spark, a.db, batch.put(a.key, a.value))
    elif a.verb == "merge":
        append(spark, a.db, batch.merge(a.key, a.value))
    elif a.verb == "delete":
        append(spark, a.db, batch.delete(a.key))
    elif a.verb == "singledelete":
        append(spark, a.db, batch.single_delete(a.key))
    elif a.verb == "deleterange":
        append(spark, a.db, batch.delete_range(a.begin, a.end))
    elif a.verb == "batchput":
        if len(a.pairs) % 2:
            raise writes.InvalidArgument("batchput takes keys and values")
        for k, x in zip(a.pairs[::2], a.pairs[1::2], strict=True):
            batch.put(k, x)
        append(spark, a.db, batch)
    elif a.verb in ("scan", "dump"):
        rows = ranges.scan(kv(a.seq), "key", getattr(a, "from"), a.to).orderBy("key")
        n = show(rows, out, a.max_keys)
        if a.verb == "dump":
            out.write(f"Keys in range: {n}\n")
    elif a.verb == "query":
        kv().createOrReplaceTempView("kv")
        log.createOrReplaceTempView("log")
        show(spark.sql(a.sql), out)
    elif a.verb == "idump":
        show(log.select("key", "seq", "op", "value", "end").orderBy("key", F.desc("seq")), out, a.max_keys)
    elif a.verb == "dump_wal":
        show(log.where(F.col("seq") >= (a.since or 0)).orderBy("seq").select("seq", "op", "key", "value", "end"), out)
    elif a.verb == "approxsize":
        show(ranges.scan(log, "key", getattr(a, "from"), a.to).agg(F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0))), out)
    elif a.verb == "list_file_range_deletes":
        show(writes.split_log(log)[1].orderBy("begin", "seq"), out)
    elif a.verb == "list_tables":
        out.write("".join(t + "\n" for t in archive.tables(spark, a.db)))
    elif a.verb == "list_live_files_metadata":
        show(archive.file_stats(spark, f"{a.db}/log", "key", ["seq"], "op").orderBy("file"), out)
    elif a.verb == "file_checksum_dump":
        show(layout.file_checksums(spark, f"{a.db}/log").orderBy("file"), out)
    elif a.verb == "checkconsistency":
        twice = log.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
        wrong = log.where((F.col("op") == writes.DELETE_RANGE) & (F.col("key") > F.col("end"))).count()
        out.write("OK\n" if not twice + wrong else f"{twice} sequences repeat, {wrong} range deletes are inverted\n")
        return int(bool(twice + wrong))
    elif a.verb == "get_property":
        known = {"num-entries": F.count(F.lit(1)), "num-deletes": F.sum(F.col("op").isin("delete", "single_delete").cast("long")), "latest-sequence": F.max("seq"), "estimate-num-keys": F.countDistinct("key")}
        if a.name not in known:
            raise writes.InvalidArgument(f"no property {a.name!r}; there are {', '.join(known)}")
        show(log.agg(known[a.name]), out)
    elif a.verb == "compact":
        points, tombs = writes.split_log(log)
        compact(points, LOG, tombstones=tombs, fold=a.merge_operator).withColumn("end", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{a.db}/compacted")
        spark.read.parquet(f"{a.db}/compacted").write.mode("overwrite").parquet(f"{a.db}/log")
        archive.delete(spark, f"{a.db}/compacted")
    elif a.verb == "checkpoint":
        layout.checkpoint(log, f"{a.path}/log", "seq", a.seq if a.seq is not None else 2**62)
    elif a.verb == "backup":
        out.write(f"{archive.Backups(spark, a.path, LOG).create(log)}\n")
    elif a.verb == "restore":
        archive.Backups(spark, a.path, LOG).restore(a.version).write.mode("overwrite").parquet(f"{a.db}/log")
    elif a.verb == "dump_table":
        archive.dump(kv(), a.path, "key", "value")
    elif a.verb == "load":
        rows = archive.undump(spark, a.path).withColumn("ordinal", F.monotonically_increasing_id())
        rows = writes.commit(log.select("key", "seq", "op", "value", "end"), rows.select("ordinal", "key", F.lit("put").alias("op"), "value"))
        rows.join(log.select("seq"), "seq", "left_anti").select("key", "seq", "op", "value", "end").write.mode("append").parquet(f"{a.db}/log")
    elif a.verb == "write_extern_sst":
        layout.write_sorted(kv(), a.path, "key")
    elif a.verb == "ingest_extern_sst":
        top = (log.agg(F.max("seq")).first()[0] or 0) + 1
        spark.read.parquet(a.path).select("key", F.lit(top).cast("long").alias("seq"), F.lit("put").alias("op"), "value", F.lit(None).cast("string").alias("end")).write.mode("append").parquet(f"{a.db}/log")
    return 0



if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
