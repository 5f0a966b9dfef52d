"""Copies of tables: backups with versions, export and import, logical dumps, out-of-line values, file listings.

Everything is a folder that Spark's readers and writers reach; folders are listed and deleted through Hadoop's file system, so
that paths in any store work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.operators.schema import Log


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; false where there is none."""
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables (folders or files of Parquet) in a folder, sorted."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n.removesuffix(".parquet") for n in names if not n.startswith(("_", ".")))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified) of a table's data files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def oldest_file(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).agg(F.min("modified").alias("oldest"))


def file_stats(spark: SparkSession, path: str, key: str, columns: list[str], op: str | None = None) -> DataFrame:
    """Per file: rows, its least and greatest key, ends of the columns, and, with op, rows of each operation."""
    df = spark.read.parquet(path)
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(key).alias("smallest"), F.max(key).alias("largest")]
    aggs += [f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))]
    if op:
        aggs += [F.sum((F.col(op) == o).cast("long")).alias(o + "s") for o in ("put", "delete", "merge")]
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(*aggs)


def read_files(spark: SparkSession, path: str, wanted: Column, stats: DataFrame) -> DataFrame:
    """The rows of the files whose row of ``stats`` (see file_stats) is wanted; other files aren't opened."""
    names = [r["file"] for r in stats.where(wanted).select("file").collect()]  # one row a file
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def digests(df: DataFrame) -> DataFrame:
    """(rows, digest): an order-independent digest of a table's rows."""
    parts = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(parts), F.lit(0)).alias("digest"), F.coalesce(F.sum(F.pmod(parts, F.lit(1_000_003))), F.lit(0)).alias("sum"))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, status) against a manifest of ``layout.file_checksums``: ok, changed, missing, or unknown."""
    from kvlog.sources.layout import file_checksums

    now = file_checksums(spark, path).select("file", F.col("rows").alias("r"), F.col("digest").alias("g"))
    both = manifest.join(now, "file", "full")
    status = F.when(F.col("g").isNull(), "missing").when(F.col("digest").isNull(), "unknown").when((F.col("g") == F.col("digest")) & (F.col("r") == F.col("rows")), "ok").otherwise("changed")
    return both.select("file", status.alias("status"))


class Backups:
    """Incremental backups of a log: each version holds the rows above the sequence of the one before, and a manifest row."""

    def __init__(self, spark: SparkSession, path: str, d: Log):
        self.spark, self.path, self.d = spark, path, d

    def _manifest(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/manifest") if exists(self.spark, f"{self.path}/manifest") else None

    def list(self) -> DataFrame:
        """(version, top, rows, digest, sum) of the versions that are kept; top is the greatest sequence."""
        m = self._manifest()
        if m is None:
            return self.spark.createDataFrame([], "version long, top long, rows long, digest long, sum long")
        gone = m.where("purged").select("version")
        return m.where("NOT purged").join(gone, "version", "left_anti").select("version", "top", "rows", "digest", "sum")

    def create(self, log: DataFrame, metadata: int | None = None) -> int:
        m = self._manifest()
        last = m.agg(F.max("version").alias("v"), F.max("top").alias("top")).first() if m is not None else None
        version, above = (last["v"] + 1, last["top"]) if last and last["v"] is not None else (1, None)
        new = log if above is None else log.where(F.col(self.d.seq) > above)
        at = f"{self.path}/data/v={version}"
        new.write.mode("overwrite").parquet(at)  # a backup that broke off is written anew
        kept = self.spark.read.parquet(at)
        row = digests(kept).crossJoin(kept.agg(F.max(self.d.seq).cast("long").alias("top")))
        row = row.select(F.lit(version).cast("long").alias("version"), F.coalesce("top", F.lit(above).cast("long"), F.lit(-1).cast("long")).alias("top"), F.col("rows").cast("long").alias("rows"), F.col("digest").cast("long").alias("digest"), F.col("sum").cast("long").alias("sum"), F.lit(False).alias("purged"))
        row.write.mode("append").parquet(f"{self.path}/manifest")
        return version

    def _whole(self, version: int) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/data/v={v}") for v in range(1, version + 1) if exists(self.spark, f"{self.path}/data/v={v}")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def restore(self, version: int | None = None) -> DataFrame:
        """The log as it was backed up; the newest version if none is named.  Raises for versions that aren't kept or fail verification."""
        kept = sorted(r["version"] for r in self.list().collect())
        version = version or (kept[-1] if kept else 0)
        if version not in kept:
            raise ValueError(f"no backup {version}")
        broken = [r["version"] for r in self.verify().where(~F.col("ok") & (F.col("version") <= version)).collect()]
        if broken:
            raise ValueError(f"backup {version} needs versions that fail verification: {broken}")
        return self._whole(version)

    def verify(self) -> DataFrame:
        """(version, ok): whether each version's rows are those of its manifest row."""
        rows = []
        for r in self._manifest().where("NOT purged").collect() if self._manifest() is not None else []:
            at = f"{self.path}/data/v={r['version']}"
            now = digests(self.spark.read.parquet(at)).first() if exists(self.spark, at) else None
            rows.append((r["version"], now is not None and (now["rows"], now["digest"], now["sum"]) == (r["rows"], r["digest"], r["sum"])))
        return self.spark.createDataFrame(rows, "version long, ok boolean")

    def purge(self, keep: int) -> None:
        """Only the newest ``keep`` versions can be restored from now on; rows that these need stay."""
        kept = sorted(r["version"] for r in self.list().collect())
        gone = kept[:-keep] if keep else kept
        if gone:
            rows = [(v, None, None, None, None, True) for v in gone]
            self.spark.createDataFrame(rows, "version long, top long, rows long, digest long, sum long, purged boolean").write.mode("append").parquet(f"{self.path}/manifest")


def export_table(df: DataFrame, path: str, key: str) -> None:
    """A table with a manifest of its digest, for ``import_table``."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{path}/data")
    digests(df.sparkSession.read.parquet(f"{path}/data")).write.parquet(f"{path}/manifest")


def import_table(spark: SparkSession, path: str, move_to: str | None = None) -> DataFrame:
    """An exported table, checked against its manifest; also written to ``move_to`` where given."""
    df = spark.read.parquet(f"{path}/data")
    if digests(df).first() != spark.read.parquet(f"{path}/manifest").first():
        raise ValueError(f"{path}: data don't match the manifest")
    if move_to:
        df.write.parquet(move_to)
        return spark.read.parquet(move_to)
    return df


def dump(df: DataFrame, path: str, key: str, value: str) -> None:
    """A portable logical dump: lines of hex key, tab, hex value, in key order; a null value has no second field."""
    line = F.concat_ws("\t", F.hex(F.col(key).cast("string").cast("binary")), F.hex(F.col(value).cast("string").cast("binary")))
    df.repartitionByRange(key).sortWithinPartitions(key).select(line.alias("value")).write.text(path)


def undump(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a dump, as text."""
    parts = F.split("value", "\t")
    back = lambda i: F.unhex(F.get(parts, F.lit(i))).cast("string")
    return spark.read.text(path).select(back(0).alias("key"), back(1).alias("value"))


def write_by_prefix(df: DataFrame, path: str, key: str, n: int) -> None:
    """Files that hold keys of one prefix of n characters each, so that a prefix is read or dropped as whole files."""
    df.withColumn("prefix", F.substring(F.col(key).cast("string"), 1, n)).repartition("prefix", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("prefix", key).write.partitionBy("prefix").parquet(path)


def separate(log: DataFrame, d: Log, least: int) -> tuple[DataFrame, DataFrame]:
    """(log, blobs): values of at least ``least`` bytes go out of line, under their digest, each content once."""
    value = d.value[0]
    large = F.octet_length(value) >= least
    sha = F.when(large, F.sha2(F.col(value).cast("binary"), 256))
    inline = log.withColumn("blob", sha).withColumn(value, F.when(~F.coalesce(large, F.lit(False)), F.col(value)))
    blobs = log.where(large).select(F.sha2(F.col(value).cast("binary"), 256).alias("blob"), F.col(value).alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
    return inline, blobs


def resolve_blobs(log: DataFrame, blobs: DataFrame, d: Log) -> DataFrame:
    """The log with its values in line again."""
    value = d.value[0]
    return log.join(blobs, "blob", "left").withColumn(value, F.coalesce(value, "content")).drop("blob", "content")


def collect_blobs(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs that some row still refers to."""
    return blobs.join(log.select("blob").distinct(), "blob", "left_semi")


def blob_stats(log: DataFrame, value: str, least: int) -> DataFrame:
    """Values and bytes that would be out of line, and in line."""
    return log.where(F.col(value).isNotNull()).groupBy((F.octet_length(value) >= least).alias("out_of_line")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(value)).cast("long").alias("bytes"))
