"""Greedy grouping of sorted boxes or intervals: a group grows until its bounding box is too large."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.sources.package import give


def group_boxes(df: DataFrame, box: tuple[str, str, str, str], run: str, order: str, most: float) -> DataFrame:
    """(run, number, x0, x1, y0, y1, n): within each run (a file), boxes in the order of ``order`` join the current group until
    its box would have an area over ``most``; the one that would starts the next.  Boxes with a null or NaN edge are left out.

    The walk is sequential within a run; a task holds one group at a time.
    """
    give(df.sparkSession)
    cols = [F.col(c).cast("double").alias(n) for c, n in zip(box, ("x0", "x1", "y0", "y1"), strict=True)]
    rows = df.select(F.col(run).cast("long").alias("run"), F.col(order).alias("at"), *cols).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("x0", "x1", "y0", "y1")))
    dealt = rows.repartition("run").sortWithinPartitions("run", "at", "x0", "x1", "y0", "y1").drop("at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, cur, n = None, 0, None, 0
        for batch in batches:
            out: list[tuple] = []
            for r, x0, x1, y0, y1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now:
                    if cur:
                        out.append((now, number, *cur, n))
                    now, number, cur, n = r, 0, None, 0
                grown = (min(cur[0], x0), max(cur[1], x1), min(cur[2], y0), max(cur[3], y1)) if cur else (x0, x1, y0, y1)
                if cur and (grown[1] - grown[0]) * (grown[3] - grown[2]) > most:
                    out.append((now, number, *cur, n))
                    number, cur, n = number + 1, (x0, x1, y0, y1), 1
                else:
                    cur, n = grown, n + 1
            yield _batch(out)
        if cur:
            yield _batch([(now, number, *cur, n)])

    return dealt.mapInArrow(walk, "run long, number long, x0 double, x1 double, y0 double, y1 double, n long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["run", "number", "x0", "x1", "y0", "y1", "n"])


def group_ranges(df: DataFrame, low: str, high: str, run: str, order: str, most: float) -> DataFrame:
    """As group_boxes for intervals: (run, number, lo, hi, n), groups no wider than ``most``."""
    flat = df.withColumns({"_y0": F.lit(0.0), "_y1": F.lit(1.0)})
    out = group_boxes(flat, (low, high, "_y0", "_y1"), run, order, most)
    return out.select("run", "number", F.col("x0").alias("lo"), F.col("x1").alias("hi"), "n")
