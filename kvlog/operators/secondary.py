"""Scans over non-key attributes: box and value-range predicates in three modes, and joins with a set of query boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.operators.resolve import latest, visible
from kvlog.operators.schema import PUT, Log

#: Query boxes are broadcast up to this many; beyond, boxes meet in grid cells.
BROADCAST_QUERIES = 10_000
#: A box that covers more grid cells meets others in wider ones.
CELLS_A_BOX = 64


def secondary_scan(log: DataFrame, d: Log, predicate: Column, mode: str = "latest", seq: int | None = None) -> DataFrame:
    """raw: every put that matches.  memo: raw hits that no later version of the key replaced.  latest: the newest visible
    version, then the predicate.  two_pass: as latest, but only keys with a matching version are resolved, so the
    predicate prunes the first scan."""
    if mode == "latest":
        return latest(log, d, seq).where(predicate)
    puts = visible(log, d, seq)
    if d.op:
        puts = puts.where(F.col(d.op) == PUT)
    if mode == "raw":
        return puts.where(predicate)
    if mode == "memo":
        memo = visible(log, d, seq).groupBy(*d.key).agg(F.max(d.seq).alias("_memo"))
        return puts.where(predicate).join(memo, list(d.key)).where(F.col("_memo") <= F.col(d.seq)).drop("_memo")
    if mode == "two_pass":
        candidates = puts.where(predicate).select(*d.key).distinct()
        return latest(log.join(candidates, list(d.key), "left_semi"), d, seq).where(predicate)
    raise ValueError(f"unknown mode {mode!r}")


def _cells(x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> Column:
    xs = F.sequence(F.floor(x0 / size), F.floor(x1 / size))
    ys = F.sequence(F.floor(y0 / size), F.floor(y1 / size))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def box_join(data: DataFrame, queries: DataFrame, box: tuple[str, str, str, str], row_id: str, cell: float | None = None, salts: int = 8) -> DataFrame:
    """(qid, row) of every query box (qid, x0, x1, y0, y1) and row that touch; boxes with a null or NaN edge touch nothing.

    Few queries are broadcast.  Many meet the rows in grid cells by an equi join; a pair is reported only in the cell
    of the lower corner of its overlap, so nothing has to be made distinct.  A cell's rows are dealt over salts, its queries
    go to each.  Boxes of more than CELLS_A_BOX cells don't expand: they meet the others by broadcast where the queries are few,
    else in cells CELLS_A_BOX times as wide.
    """
    xmin, xmax, ymin, ymax = map(F.col, box)
    touch = (xmax >= F.col("x0")) & (xmin <= F.col("x1")) & (ymax >= F.col("y0")) & (ymin <= F.col("y1"))
    whole = lambda cs: ~F.greatest(*[F.isnan(c.cast("double")).cast("int") for c in cs]).cast("boolean")
    rows = data.select(row_id, *box).where(whole((xmin, xmax, ymin, ymax)) & (xmin <= xmax) & (ymin <= ymax))
    queries = queries.where(whole([F.col(c) for c in ("x0", "x1", "y0", "y1")]) & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    if cell is None and queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        return rows.join(F.broadcast(queries), touch).select("qid", row_id)
    size = cell or max(queries.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0, 1e-9)
    assert math.isfinite(size)

    def met(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
        a = a.withColumn("_c", F.explode(_cells(xmin, xmax, ymin, ymax, size))).withColumn("_salt", F.pmod(F.xxhash64(row_id, *box), F.lit(salts)).cast("int")).select("*", "_c.*").drop("_c")
        b = b.withColumn("_c", F.explode(_cells(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), size))).withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts))))).select("*", "_c.*").drop("_c")
        first = (F.col("cx") == F.floor(F.greatest(xmin, F.col("x0")) / size)) & (F.col("cy") == F.floor(F.greatest(ymin, F.col("y0")) / size))
        return a.join(b, ["cx", "cy", "_salt"]).where(touch & first).select("qid", row_id)

    cells = lambda x0, x1, y0, y1: ((x1 - x0) / size + 2) * ((y1 - y0) / size + 2)
    wide_row, wide_query = cells(xmin, xmax, ymin, ymax) > CELLS_A_BOX, cells(*map(F.col, ("x0", "x1", "y0", "y1"))) > CELLS_A_BOX
    out = met(rows.where(~wide_row), queries.where(~wide_query), size)
    for some, others in ((rows.where(~wide_row), queries.where(wide_query)), (rows.where(wide_row), queries)):
        if some.isEmpty() or others.isEmpty():
            continue
        wider = None if others.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else size * CELLS_A_BOX
        out = out.unionByName(box_join(some, others, box, row_id, wider, salts))
    return out
