"""Interval operators on timelines: alignment, coverage, gaps, segments from points, range lookups.

Every table has run_id; intervals are (s, e) in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared seconds; null where any bound is, for least and greatest would skip it."""
    whole = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(whole, F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)))


def distance(ts: Column, te: Column, vs: Column, ve: Column, at: Column) -> Column:
    """The smaller of the gap between the intervals and that from the transcript's middle to the visual's own time."""
    gap = F.when(te < vs, vs - te).when(ve < ts, ts - ve).otherwise(0)
    return F.least(gap, F.abs((ts + te) / 2 - at))


def lead_segments(points: DataFrame, longest: int, last: int) -> DataFrame:
    """Points (run_id, seg_id, s) as segments that end with the next point, after ``longest`` at most; the last one after ``last``. idx counts from 1."""
    order = Window.partitionBy("run_id").orderBy("s", "seg_id")
    end = F.least(F.col("s") + longest, F.coalesce(F.lead("s").over(order), F.col("s") + last))
    return points.withColumns({"idx": F.row_number().over(order), "e": end})


def align(transcript: DataFrame, visual: DataFrame, nearest: int, bucket: int) -> DataFrame:
    """Each transcript segment (run_id, seg_id, s, e) with the visual segment (run_id, idx, seg_id, s, e, at) that explains it best.

    The longest overlap wins, the first index among equals; without any, the nearest within ``nearest`` seconds; rows without either stay, unmatched.
    Both sides are spread over time buckets, so the range join is an equi-join on run and bucket, and the winner is an
    aggregate with a map-side part. A pair that meets in several buckets is the same pair, and max and min don't mind.
    Segments of a run with the same times have the same answer and meet once, and of visual segments with the same times
    the first alone: what is there many times over costs no pairs."""
    t = transcript.select("run_id", "seg_id", F.col("s").alias("ts"), F.col("e").alias("te"))
    v = visual.select("run_id", "idx", F.col("seg_id").alias("visual_id"), F.col("s").alias("vs"), F.col("e").alias("ve"), F.col("at"))
    wanted = t.select("run_id", "ts", "te").distinct()
    once = v.groupBy("run_id", "vs", "ve", "at").agg(F.min(F.struct("idx", "visual_id")).alias("f")).select("run_id", "vs", "ve", "at", "f.*")
    spread = lambda low, high: F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket)))
    tb = wanted.withColumn("bucket", spread(F.col("ts") - nearest, F.greatest("ts", "te") + nearest))
    vb = once.withColumn("bucket", spread(F.least("vs", "at"), F.greatest("ve", "at")))
    shared = overlap(F.col("ts"), F.col("te"), F.col("vs"), F.col("ve"))
    apart = distance(F.col("ts"), F.col("te"), F.col("vs"), F.col("ve"), F.col("at"))
    # Spark sizes an explode like the table before it: without the hint it may broadcast many times of what it takes for small
    best = tb.hint("merge").join(vb, ["run_id", "bucket"]).select("run_id", "ts", "te", "idx", "visual_id", shared.alias("overlap"), apart.alias("distance"))
    best = best.where((F.col("overlap") > 0) | (F.col("distance") <= nearest)).groupBy("run_id", "ts", "te").agg(
        F.max(F.when(F.col("overlap") > 0, F.struct("overlap", (-F.col("idx")).alias("first"), "visual_id"))).alias("hit"),
        F.min(F.when(F.col("distance") <= nearest, F.struct("distance", "idx", "visual_id"))).alias("near"),
    )
    best = best.select(F.col("run_id").alias("__run"), F.col("ts").alias("__ts"), F.col("te").alias("__te"), "hit", "near")
    # an end may be null, and what lies near is still found
    joined = t.hint("merge").join(best, (F.col("run_id") == F.col("__run")) & (F.col("ts") == F.col("__ts")) & F.col("te").eqNullSafe(F.col("__te")), "left")
    hit, near = F.col("hit").isNotNull(), F.col("near").isNotNull()
    return joined.select(
        "run_id",
        "seg_id",
        F.when(hit, F.col("hit.visual_id")).otherwise(F.col("near.visual_id")).alias("visual_id"),
        F.when(hit, "time_overlap").when(near, "nearest_visual_segment").otherwise("unaligned").alias("match_reason"),
        F.when(hit, F.col("hit.overlap")).otherwise(0).cast("double").alias("overlap_seconds"),
        F.when(~hit, F.col("near.distance")).cast("double").alias("distance_seconds"),
        F.when(hit & (F.col("hit.overlap") >= 0.5 * (F.col("te") - F.col("ts"))), "high").when(hit, "medium").when(near, "low").otherwise("none").alias("confidence"),
    )


def coverage(transcript: DataFrame, visual: DataFrame) -> DataFrame:
    """Span of both sides of each run, and the share of the transcript's span and end that the visual side reaches."""
    side = lambda df, p: df.groupBy("run_id").agg(F.min("s").alias(f"{p}_start"), F.max("e").alias(f"{p}_end"))
    both = side(transcript, "transcript").join(side(visual, "visual"), "run_id", "left")
    span = lambda p: F.greatest(F.lit(0), F.col(f"{p}_end") - F.col(f"{p}_start"))
    held = F.col("visual_end").isNotNull()
    both = both.withColumns({"transcript_duration": span("transcript"), "visual_duration": F.when(held, span("visual"))})
    return both.withColumn("duration_ratio", F.round(F.try_divide("visual_duration", "transcript_duration"), 6))


def gaps(segments: DataFrame) -> DataFrame:
    """Number and length of the gaps over a millisecond between neighbours, by start."""
    order = Window.partitionBy("run_id").orderBy("s", "seg_id")
    gap = F.col("s") - F.lag("e").over(order)
    found = segments.withColumn("gap", F.when(gap > 0.001, gap))
    return found.groupBy("run_id").agg(F.count("gap").alias("gap_count"), F.coalesce(F.max("gap"), F.lit(0)).cast("double").alias("max_gap"))


def lookahead(items: DataFrame, within: int, context: float, fuller: float) -> DataFrame:
    """For each item (run_id, seg_id, s, value) the later one within so many seconds, of the same context and fuller by enough, with the highest value; the earlier of equals.

    Items are put into their own and the next bucket, so the self join is on run and bucket."""
    early = items.select("run_id", "seg_id", F.col("s").alias("s0"), F.col("value").alias("v0"), F.floor(F.col("s") / within).alias("bucket"))
    late = items.select("run_id", F.col("seg_id").alias("later_id"), F.col("s").alias("s1"), F.col("value").alias("v1"), F.explode(F.array(F.floor(F.col("s") / within), F.floor(F.col("s") / within) - 1)).alias("bucket"))
    step = F.col("v1") - F.col("v0")
    pairs = early.join(late, ["run_id", "bucket"]).where((F.col("s1") > F.col("s0")) & (F.col("s1") - F.col("s0") <= within) & (step >= fuller) & (step <= context))
    best = pairs.groupBy("run_id", "seg_id").agg(F.count(F.lit(1)).alias("n_fuller"), F.max(F.struct("v1", (-F.col("s1")).alias("s"), (-F.col("later_id")).alias("id"))).alias("best"))
    return best.select("run_id", "seg_id", "n_fuller", (-F.col("best.id")).alias("later_id"))
