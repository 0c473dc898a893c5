"""Which region of a frame is compared, and the crop of a frame to it.

A frame is an array of gray values, row by row. Regions that can't be resolved are the
full frame with a warning, so that no frame drops out for its settings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def _box(left: Column, top: Column, right: Column, bottom: Column, mode: Column, warning: Column) -> Column:
    status = F.when(warning.isNotNull(), "fallback_full_frame").when(mode == "full_frame", "full_frame").otherwise("active")
    sides = [x.cast("int").alias(n) for n, x in (("left", left), ("top", top), ("right", right), ("bottom", bottom))]
    return F.struct(*sides, mode.alias("mode"), status.alias("status"), warning.alias("warning"))


def region(width: Column, height: Column, mode: Column, percent: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Struct of left, top, right, bottom (pixels), mode, status and warning.

    mode: full_frame, center_crop (by percent of both sides) or manual (by normalized bounds); - stands for _, blank for full_frame."""
    asked = F.replace(F.lower(F.trim(F.coalesce(mode, F.lit("")))), F.lit("-"), F.lit("_"))
    asked = F.when(asked.isin("", "full"), "full_frame").otherwise(asked)
    w, h = F.greatest(F.lit(1), _whole(width * percent)), F.greatest(F.lit(1), _whole(height * percent))
    x, y = F.greatest(F.lit(0), F.floor((width - w) / 2)), F.greatest(F.lit(0), F.floor((height - h) / 2))
    bounds = [left, top, right, bottom]
    held = left.isNotNull() & top.isNotNull() & right.isNotNull() & bottom.isNotNull()
    valid = (left >= 0) & (left < right) & (right <= 1) & (top >= 0) & (top < bottom) & (bottom <= 1)
    pixels = [_whole(side * bound) for side, bound in zip((width, height, width, height), bounds, strict=True)]
    empty = (pixels[2] <= pixels[0]) | (pixels[3] <= pixels[1])
    center, manual = asked == "center_crop", asked == "manual"
    warning = (
        F.when(asked == "full_frame", F.lit(None).cast("string"))
        .when(center, F.when(~F.coalesce((percent > 0) & (percent <= 1), F.lit(False)), F.lit("center crop must be above 0 and at most 1")))
        .when(manual & ~held, "manual crop needs left, top, right and bottom")
        .when(manual & ~valid, "manual crop needs bounds in order within 0 and 1")
        .when(manual & empty, "manual crop is empty")
        .when(manual, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("unknown comparison_region_mode: "), asked))
    )
    ok = warning.isNull()
    return _box(
        F.when(ok & center, x).when(ok & manual, pixels[0]).otherwise(0),
        F.when(ok & center, y).when(ok & manual, pixels[1]).otherwise(0),
        F.when(ok & center, F.least(width, x + w)).when(ok & manual, pixels[2]).otherwise(width),
        F.when(ok & center, F.least(height, y + h)).when(ok & manual, pixels[3]).otherwise(height),
        F.when(ok, asked).otherwise("full_frame"),
        warning,
    )


def of_options(width: Column, height: Column, options: dict) -> Column:
    """The region that the visual options of :mod:`tidemark.sources.options` ask for."""
    number = lambda key: F.lit(options[f"comparison_{key}"]).cast("double")
    sides = [number(f"crop_{side}") for side in ("left", "top", "right", "bottom")]
    return region(width, height, F.lit(options["comparison_region_mode"]), number("center_crop_percent"), *sides)


def crop(values: Column, width: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The gray values of a frame of this width within a box of pixels."""
    rows = F.when(bottom > top, F.sequence(top, bottom - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(rows, lambda y: F.slice(values, y * width + left + 1, F.greatest(right - left, F.lit(0)))))


def relative_crop(values: Column, width: Column, height: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """The gray values within normalized bounds, cut down to whole pixels and held within the frame."""
    at = lambda side, bound: F.greatest(F.lit(0), F.least(side, (side * F.lit(bound)).cast("int")))
    return crop(values, width, at(width, left), at(height, top), at(width, right), at(height, bottom))
