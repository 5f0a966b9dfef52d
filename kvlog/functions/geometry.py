"""Boxes, value ranges, Z-order and Hilbert values; plain expressions, so filters reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def intersects(box: tuple[str, str, str, str], query: tuple[float, float, float, float] | None) -> Column:
    """Closed boxes (xmin, xmax, ymin, ymax) that touch; no query matches everything; null and NaN never match."""
    if query is None:
        return F.lit(True)
    x0, x1, y0, y1 = query
    xmin, xmax, ymin, ymax = map(F.col, box)
    no_nan = ~(F.isnan(xmax) | F.isnan(ymax) | F.isnan(xmin) | F.isnan(ymin))
    return (xmax >= x0) & (xmin <= x1) & (ymax >= y0) & (ymin <= y1) & no_nan


def in_range(value: str, query: tuple[float, float] | None) -> Column:
    if query is None:
        return F.lit(True)
    return F.col(value).between(*query) & ~F.isnan(value)


def ranges_overlap(low: str, high: str, query: tuple[float, float] | None) -> Column:
    """Closed intervals that touch; no query matches everything; null and NaN never match."""
    if query is None:
        return F.lit(True)
    return F.coalesce((F.col(low) <= query[1]) & (F.col(high) >= query[0]) & ~F.isnan(low) & ~F.isnan(high), F.lit(False))


def area(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.least(a[1], b[1]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[2], b[2])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def cell(x: Column, low: float, high: float, n: int) -> Column:
    """Cell of a grid of n, clamped at both ends."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - low) / (high - low) * n))).cast("long")


def z_value(x: Column, y: Column, bits: int) -> Column:
    """Interleaved bits of two cell numbers, x first."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(1), 2 * i + 1)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(1), 2 * i))
    return out


def z_less(a: tuple[Column, Column], b: tuple[Column, Column], bits: int = 31) -> Column:
    """Whether cell a comes before cell b in Z-order: x is the more significant of each pair of bits."""
    return z_value(*a, bits) < z_value(*b, bits)


def perimeter(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return 2 * ((x1 - x0) + (y1 - y0))


def hilbert_cell_udf(bits: int):
    """The inverse of ``hilbert_udf``: the cell struct (x, y) at a distance."""

    @F.pandas_udf("x long, y long")
    def cell_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ds in batches:
            t = ds.to_numpy().copy()
            x, y = t * 0, t * 0
            for k in range(bits):
                rx = (t >> 1) & 1
                ry = (t ^ rx) & 1
                s = 1 << k
                flip, swap = (ry == 0) & (rx == 1), ry == 0
                x[flip], y[flip] = s - 1 - x[flip], s - 1 - y[flip]
                x[swap], y[swap] = y[swap].copy(), x[swap].copy()
                x, y, t = x + s * rx, y + s * ry, t >> 2
            yield pd.DataFrame({"x": x, "y": y})

    return cell_of


def hilbert_udf(bits: int):
    """Arrow-batched distance along the Hilbert curve of order ``bits`` of two cell numbers."""

    @F.pandas_udf("long")
    def d(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            x, y = xs.to_numpy().copy(), ys.to_numpy().copy()
            out = x * 0
            s = 1 << (bits - 1)
            while s:
                rx, ry = (x & s) > 0, (y & s) > 0
                out += s * s * ((3 * rx) ^ ry)
                flip = ~ry & rx
                x[flip], y[flip] = (2 * s - 1) - (x[flip] & (2 * s - 1)), (2 * s - 1) - (y[flip] & (2 * s - 1))
                swap = ~ry
                x[swap], y[swap] = y[swap].copy(), x[swap].copy()
                s >>= 1
            yield pd.Series(out)

    return d
