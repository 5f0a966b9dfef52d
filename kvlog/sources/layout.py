"""Layouts that let Parquet statistics prune: value order, Z-order, key order; file manifests; text input; checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.functions.geometry import cell, z_value


def write_sorted(df: DataFrame, path: str, *columns: str, files: int | None = None) -> None:
    """Range-partitioned and sorted, so files and row groups cover narrow ranges of the columns."""
    dealt = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    dealt.sortWithinPartitions(*columns).write.parquet(path)


def write_z_ordered(df: DataFrame, path: str, box: tuple[str, str, str, str], extent: tuple[float, float, float, float], bits: int = 16, files: int | None = None) -> None:
    """Sorted by the Z value of the boxes' centres; the order changes what can be skipped, never what is found."""
    x0, x1, y0, y1 = extent
    cx = cell((F.col(box[0]) + F.col(box[1])) / 2, x0, x1, 1 << bits)
    cy = cell((F.col(box[2]) + F.col(box[3])) / 2, y0, y1, 1 << bits)
    write_sorted(df.withColumn("z", z_value(cx, cy, bits)), path, "z", files=files)


def manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Per file: rows, and the least and greatest value of the columns."""
    ends = [f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))]
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends)


def read_boxes_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lines: id, perimeter, x0, y0, x1, y1, rest."""
    return spark.read.csv(path, sep="\t", schema="id long, perimeter double, x0 double, y0 double, x1 double, y1 double, rest string")


def checkpoint(log: DataFrame, path: str, seq: str, at: int) -> None:
    log.where(F.col(seq) <= at).write.parquet(path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per file an order-independent digest of its rows."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))
