"""Summed-area tables: sums over any box of a frame from four numbers, whatever the box's size.

A table of a frame of w by h values is an array of (w + 1) * (h + 1) sums, row by row: that at
(x, y) is over all values left of x and above y. It is made once a frame; what is asked of boxes
after that (means, variances, shares, resampled hashes) are JVM expressions on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Box = tuple[Column, Column, Column, Column]


def _each(values: pa.Array, width: pa.Array, of) -> pa.Array:
    """of(the frame as a matrix) flattened, for each frame; null where the values do not fill whole rows."""
    out, widths = [], width.to_numpy(zero_copy_only=False)
    for k in range(len(values)):
        held, w = values[k], widths[k]
        if not held.is_valid or w != w or w <= 0 or len(held) == 0 or len(held) % int(w):
            out.append(None)
        else:
            out.append(of(held.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, int(w))).ravel())
    return pa.array(out, pa.list_(pa.int64()))


def _summed(x: np.ndarray) -> np.ndarray:
    return np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def summed(values: pa.Array, width: pa.Array) -> pa.Array:
    """The summed-area table of each frame (an array of whole numbers, row by row, and its width)."""
    return _each(values, width, _summed)


@F.arrow_udf(T.ArrayType(T.LongType()))
def summed_steps(values: pa.Array, width: pa.Array, threshold: pa.Array) -> pa.Array:
    """The table of a frame's steps of over threshold to the right neighbour, then that to the lower one; a last column or row has no step."""
    least = threshold[0].as_py() if len(threshold) else 0

    def of(x: np.ndarray) -> np.ndarray:
        right, down = np.zeros_like(x), np.zeros_like(x)
        right[:, :-1], down[:-1] = np.abs(np.diff(x, axis=1)) > least, np.abs(np.diff(x, axis=0)) > least
        return np.concatenate([_summed(right).ravel(), _summed(down).ravel()])

    return _each(values, width, of)


@F.arrow_udf(T.ArrayType(T.LongType()))
def counted(values: pa.Array, width: pa.Array, left: pa.Array, top: pa.Array, right: pa.Array, bottom: pa.Array) -> pa.Array:
    """How often each of the values 0 to 255 is in each frame's box."""
    sides = [x.to_numpy(zero_copy_only=False) for x in (left, top, right, bottom)]
    boxes = iter(zip(*sides, strict=True))
    out = []
    for k, (x0, y0, x1, y1) in enumerate(boxes):
        held, w = values[k], width[k].as_py()
        if not held.is_valid or not w or len(held) % w:
            out.append(None)
            continue
        frame = held.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, w)
        out.append(np.bincount(frame[int(y0) : int(y1), int(x0) : int(x1)].clip(0, 255).ravel(), minlength=256))
    return pa.array(out, pa.list_(pa.int64()))


def box(width: Column, height: Column, left: float, top: float, right: float, bottom: float) -> Box:
    """Normalized bounds as whole pixels, cut down and held within the frame."""
    at = lambda side, bound: F.greatest(F.lit(0), F.least(side, (side * F.lit(bound)).cast("int")))
    return at(width, left), at(height, top), at(width, right), at(height, bottom)


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def box_sum(table: Column, width: Column, b: Box, skip: Column | int = 0) -> Column:
    """The sum over a box of what the table is of; skip: where the table begins in its array."""
    at = lambda x, y: F.get(table, (y * (width + 1) + x + skip).cast("int"))
    left, top, right, bottom = b
    return at(right, bottom) - at(left, bottom) - at(right, top) + at(left, top)


def box_mean(table: Column, width: Column, b: Box) -> Column:
    """0 for an empty box."""
    return F.coalesce(box_sum(table, width, b) / F.nullif(area(b), F.lit(0)), F.lit(0.0))


def box_variance(table: Column, squares: Column, width: Column, b: Box) -> Column:
    """By exact sums; 0 for an empty box."""
    n, s = area(b), box_sum(table, width, b)
    return F.coalesce((n * box_sum(squares, width, b) - s * s) / F.nullif(n * n, F.lit(0)), F.lit(0.0))


def box_detail(steps: Column, width: Column, height: Column, b: Box) -> Column:
    """The share of a box's neighbours, right and lower, that differ by over the steps' threshold; 0 for a box of one row or column."""
    left, top, right, bottom = b
    w, h = right - left, bottom - top
    second = (width + 1) * (height + 1)
    large = box_sum(steps, width, (left, top, right - 1, bottom)) + box_sum(steps, width, (left, top, right, bottom - 1), second)
    return F.when((w > 1) & (h > 1), large / (h * (w - 1) + w * (h - 1))).otherwise(0.0)


def _edges(low: int, size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where parts of a side begin and end, each of a pixel at least; those of a short side overlap."""
    k = np.arange(parts)
    first = size * k // parts
    return low + first, low + np.maximum(size * (k + 1) // parts, first + 1)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def box_hash(tables: pa.Array, width: pa.Array, left: pa.Array, top: pa.Array, right: pa.Array, bottom: pa.Array) -> pa.Array:
    """64 bits: whether each of 8 by 8 parts of a box is brighter in the mean than the parts are in theirs, four sums a part. An empty box has none."""
    out = []
    sides = zip(*(x.to_pylist() for x in (width, left, top, right, bottom)), strict=True)
    for k, (w, x0, y0, x1, y1) in enumerate(sides):
        held = tables[k]
        if not held.is_valid or x1 <= x0 or y1 <= y0:
            out.append([])
            continue
        table = held.values.to_numpy(zero_copy_only=False).reshape(-1, w + 1)
        (xa, xb), (ya, yb) = _edges(x0, x1 - x0, 8), _edges(y0, y1 - y0, 8)
        sums = table[np.ix_(yb, xb)] - table[np.ix_(yb, xa)] - table[np.ix_(ya, xb)] + table[np.ix_(ya, xa)]
        means = (sums / np.outer(yb - ya, xb - xa)).ravel()
        out.append((means > sum(means.tolist()) / 64).astype(int).tolist())
    return pa.array(out, pa.list_(pa.int32()))


def box_layout(ink: Column, width: Column, b: Box, grid: int = 4, least: float = 0.08) -> Column:
    """The share of grid * grid parts with ink on over least of them; a box under the grid's size gives 0."""
    w, h = F.floor((b[2] - b[0]) / grid).cast("int"), F.floor((b[3] - b[1]) / grid).cast("int")
    parts = [(b[0] + x * w, b[1] + y * h, b[0] + (x + 1) * w, b[1] + (y + 1) * h) for y in range(grid) for x in range(grid)]
    full = sum(F.when(box_sum(ink, width, c) > least * w * h, 1.0).otherwise(0.0) for c in parts)
    return F.when((w > 0) & (h > 0), full / (grid * grid)).otherwise(0.0)
