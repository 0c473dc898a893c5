"""What the visual stages know of a frame, from its gray values: features of its regions, and whether it is fit to be a keyframe.

frames: run_id, id, t, width, height, px (gray values 0 to 255, row by row). The region that the
options ask for is what is compared (hist, hash); title and slide have boxes of their own. A frame
whose values do not fill its rows is not ``ok``, with the reason ``unreadable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import areas as A
from . import regions

# Boxes of a slide and of its title, by normalized left, top, right and bottom; what counts as ink, content and a step
SLIDE_BOX, TITLE_BOX = (0.0, 0.08, 0.86, 1.0), (0.04, 0.06, 0.86, 0.28)
INK, STEP = 245, 12


def tables(frames: DataFrame, ink: int = INK, step: int = STEP) -> DataFrame:
    """frames with the summed-area tables of their values, squares, ink and steps."""
    px, w = F.col("px"), F.col("width")
    return frames.withColumns({
        "sums": A.summed(px, w),
        "squares": A.summed(F.transform(px, lambda x: x * x), w),
        "ink": A.summed(F.transform(px, lambda x: (x < ink).cast("int")), w),
        "steps": A.summed_steps(px, w, F.lit(step)),
    })


def measured(held: DataFrame, b: A.Box, prefix: str = "") -> dict[str, Column]:
    """Content, detail and layout of a box."""
    w, h = F.col("width"), F.col("height")
    return {f"{prefix}content": A.box_mean(F.col("ink"), w, b), f"{prefix}detail": A.box_detail(F.col("steps"), w, h, b), f"{prefix}layout": A.box_layout(F.col("ink"), w, b)}


def reasons(mean: Column, variance: Column, sharpness: Column, options: dict) -> Column:
    """Why a frame is no keyframe by its quality, all that holds."""
    dark, bright, solid = (F.lit(options[k]) for k in ("dark_frame_mean_threshold", "bright_frame_mean_threshold", "solid_frame_variance_threshold"))
    low = variance <= solid
    rules = [("dark_frame", (mean <= dark) & low), ("bright_frame", (mean >= bright) & low), ("near_solid_frame", low), ("low_variance", variance < options["min_frame_variance"]), ("low_sharpness", sharpness < options["min_sharpness_score"])]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def described(frames: DataFrame, options: dict) -> DataFrame:
    """frames with hist, hash, title, slide, content, detail, layout, mean, variance, sharpness, region, reasons and ok; the gray values are left out."""
    w, h = F.col("width"), F.col("height")
    held = tables(frames).withColumn("region", regions.of_options(w, h, options))
    asked = tuple(F.col(f"region.{side}") for side in ("left", "top", "right", "bottom"))
    slide, title = A.box(w, h, *SLIDE_BOX), A.box(w, h, *TITLE_BOX)
    whole = (F.lit(0), F.lit(0), w, h)
    counts = A.counted(F.col("px"), w, *asked)
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    held = held.withColumn("counts", counts)
    # the mean step to a neighbour, by summed-area tables of all steps
    right = F.aggregate(F.zip_with("px", F.slice("px", 2, F.size("px")), lambda x, y: F.abs(x - y)), F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s")), lambda s, d: F.struct((s["i"] + 1).alias("i"), (s["s"] + F.when((s["i"] + 1) % w != 0, F.coalesce(d, F.lit(0))).otherwise(0)).alias("s")), lambda s: s["s"])
    down = F.aggregate(F.zip_with("px", F.slice("px", w + 1, F.size("px")), lambda x, y: F.coalesce(F.abs(x - y), F.lit(0))), F.lit(0.0), lambda s, d: s + d)
    sharp = F.when((w > 1) & (h > 1), (right + down) / (h * (w - 1) + w * (h - 1))).otherwise(0.0)
    held = held.withColumns({"mean": A.box_mean(F.col("sums"), w, whole), "variance": A.box_variance(F.col("sums"), F.col("squares"), w, whole), "sharpness": sharp})
    readable = F.col("sums").isNotNull() & (F.size("px") == w * h)
    found = F.when(F.coalesce(readable, F.lit(False)), reasons(F.col("mean"), F.col("variance"), F.col("sharpness"), options)).otherwise(F.array(F.lit("unreadable")))
    kept = [c for c in frames.columns if c != "px"]
    return held.select(
        *[f"`{c}`" for c in kept],
        F.transform("counts", lambda x: x / F.greatest(n, F.lit(1))).alias("hist"),
        A.box_hash(F.col("sums"), w, *asked).alias("hash"),
        A.box_hash(F.col("sums"), w, *title).alias("title"),
        A.box_hash(F.col("sums"), w, *slide).alias("slide"),
        *[c.alias(name) for name, c in measured(held, slide).items()],
        "mean",
        "variance",
        "sharpness",
        "region",
        found.alias("reasons"),
        (F.size(found) == 0).alias("ok"),
    )
