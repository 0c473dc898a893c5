"""Expressions on pixel arrays and feature vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def pixels(vector: Column) -> Column:
    """Components in -0.5 to 0.5 as gray values of 0 to 255."""
    return F.transform(vector, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * x.cast("double")).cast("int"))))


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def variance(values: Column) -> Column:
    """Of whole numbers, by exact sums."""
    n = F.size(values)
    return (n * total(F.transform(values, lambda x: x * x)) - total(values) * total(values)) / (n * n)


def histogram(values: Column, bins: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(values, lambda x: F.floor(x / width) == b)))


def normalized(counts: Column) -> Column:
    """Shares; a histogram without counts stays zero."""
    return F.transform(counts, lambda x: x / F.coalesce(F.nullif(total(counts), F.lit(0.0)), F.lit(1.0)))


def histogram_difference(a: Column, b: Column) -> Column:
    """Half the sum of absolute differences over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x - y))) / 2


def average_hash(values: Column) -> Column:
    """A bit for each value: above the mean or not."""
    n = F.size(values)
    return F.transform(F.zip_with(values, F.array_repeat(total(values), n), lambda x, s: x * n > s), lambda x: x.cast("int"))


def hash_difference(a: Column, b: Column, unequal: float) -> Column:
    """Share of differing bits; ``unequal`` for empty hashes or different lengths (0 for frames, 1 for handout images)."""
    bits = total(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(unequal)).otherwise(bits / F.size(a))


def difference(hist_a: Column, hash_a: Column, hist_b: Column, hash_b: Column, unequal: float = 0.0) -> Column:
    return F.greatest(histogram_difference(hist_a, hist_b), hash_difference(hash_a, hash_b, unequal))


def area_ratio(values: Column, threshold: int) -> Column:
    """Share of pixels darker than the threshold; 0 for none."""
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda x: x < threshold)) / F.size(values)).otherwise(0.0)


def neighbour_steps(values: Column, width: int, height: int) -> Column:
    """Absolute differences to the right and lower neighbours of a row-major grid."""
    right = F.filter(F.transform(F.zip_with(values, F.slice(values, 2, width * height), lambda x, y: F.abs(x - y)), lambda x, i: F.when((i % width != width - 1) & x.isNotNull(), x)), lambda x: x.isNotNull())
    down = F.filter(F.zip_with(values, F.slice(values, width + 1, width * height), lambda x, y: F.abs(x - y)), lambda x: x.isNotNull())
    return F.concat(right, down)


def detail_density(values: Column, width: int, height: int, threshold: int = 12) -> Column:
    steps = neighbour_steps(values, width, height)
    return F.size(F.filter(steps, lambda x: x > threshold)) / F.size(steps) if min(width, height) > 1 else F.lit(0.0)


def sharpness(values: Column, width: int, height: int) -> Column:
    steps = neighbour_steps(values, width, height)
    return total(steps) / F.size(steps) if min(width, height) > 1 else F.lit(0.0)


def layout_richness(values: Column, width: int, height: int, threshold: int = 245, grid: int = 4) -> Column:
    """Share of grid cells with over 8 % content; a side under the grid gives 0."""
    if min(width, height) < grid:
        return F.lit(0.0)
    w, h = width // grid, height // grid
    cells = [F.size(F.filter(F.array(*[F.get(values, F.lit(y * width + x)) for y in range(gy * h, gy * h + h) for x in range(gx * w, gx * w + w)]), lambda p: p < threshold)) for gy in range(grid) for gx in range(grid)]
    return sum(F.when(c > 0.08 * w * h, 1.0).otherwise(0.0) for c in cells) / (grid * grid)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fuller_score(content: Column, detail: Column, layout: Column, position: Column, weight: float = 1.0) -> Column:
    """How full a frame is: content, detail and layout by fixed weights, and a bonus for coming late in its group."""
    return F.round((0.45 * content + 0.25 * detail + 0.30 * layout) * weight + 0.08 * clamp(position), 6)
