"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups are split over this many salts wherever one key may hold much of the input.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset on a local master (tests) a temporary folder stands in and is registered, so that
    ``checkpoint()`` works too; on any other master it must be set, as executors don't share the driver's disk.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="kvlog-shared-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder as Parquet and read again (columnar, so later passes read only what they use)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kvlog_path = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes a table of ``stored`` once all that was made from it is itself written."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kvlog_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``, so that helper columns beside it can't clash with the input's names."""
    return df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"))


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once; a plain reference inside a lambda would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  All-ASCII texts take the byte-wise built-in; others a fixed translation."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Between words: every ASCII character that is neither a digit nor a lower-case letter (after lower-casing).
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Maximal runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text; null gives an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def smallest_of_group(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Adds ``first`` (least ``order`` among rows of equal key) and ``group_size`` to every row.

    A key may hold any share of the rows: rows are pre-aggregated per (key, salt), the at most SALTS partial
    rows of a key are merged, and the merged row goes back to each (key, salt), so that no task gets a whole group.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(key, "_salt").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = part.groupBy(key).agg(F.min("_first").alias("first"), F.sum("_n").alias("group_size"))
    back = part.select(key, "_salt").join(whole, key)
    return salted.join(back, [key, "_salt"]).drop("_salt")


#: Whole texts go to Python workers in Arrow batches of at most so many rows.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of every executor, once per context, and keeps their batches small."""
    sc = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, str(BATCH_ROWS))
    if getattr(sc, "_kvlog_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    at = pathlib.Path(tempfile.mkdtemp(prefix="kvlog-package-")) / "kvlog-package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._kvlog_shipped = True
