"""What visual runs report: covering keyframes, decision traces, limited lists, keyframe files and the run's report.

Tables by run. Times meet within a millisecond (TOLERANCE): both sides carry the number of
their millisecond, one side those beside it too, so each lookup is an equi-join on run and number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TOLERANCE = 0.001
METHOD = "ffmpeg_interval_plus_pillow_difference_v1"
#: Times listed of one side of a window.
TIMES = 30
#: Seconds of a bucket that windows and times share.
BUCKET = 180
#: Seconds of a bucket that spans of covered times and wanted times share.
SPAN_BUCKET = 1800


def _beside(t: Column) -> Column:
    at = F.floor(t / TOLERANCE)
    return F.explode(F.array(at - 1, at, at + 1))


def _same_time(wanted: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of wanted (run_id, at, ...) with each point (run_id, t, ...) less than a millisecond away."""
    left = wanted.withColumn("ms", _beside(F.col("at")))
    right = points.withColumn("ms", F.floor(F.col("t") / TOLERANCE))
    # Spark sizes an explode like the table before it: without the hint it may broadcast three times of what it takes for small
    return left.hint("merge").join(right, ["run_id", "ms"]).where(F.abs(F.col("t") - F.col("at")) < TOLERANCE).drop("ms")


def _in_spans(wanted: DataFrame, spans: DataFrame) -> DataFrame:
    """(run_id, seg_id, place, id) of wanted (run_id, seg_id, at) and the spans (run_id, place, id, first, step, n) with a time less than a millisecond away.

    Spans meet wanted times by buckets of time, as they are and not time by time; of equal ones in a run the first alone."""
    once = spans.groupBy("run_id", "first", "step", "n").agg(F.min(F.struct("place", "id")).alias("f"))
    last = F.col("first") + (F.col("n") - 1) * F.col("step")
    number = lambda t: F.floor(t / SPAN_BUCKET)
    held = once.where("n > 0").withColumn("bucket", F.explode(F.sequence(number(F.col("first") - TOLERANCE), number(last + TOLERANCE))))
    # the nearest of a span's times is that of a whole step
    k = F.when(F.col("step") > 0, F.least(F.greatest(F.round((F.col("at") - F.col("first")) / F.col("step")), F.lit(0.0)), F.col("n") - 1)).otherwise(F.lit(0.0))
    met = wanted.withColumn("bucket", number(F.col("at"))).join(held.hint("merge"), ["run_id", "bucket"])
    return met.where(F.abs(F.col("first") + k * F.col("step") - F.col("at")) < TOLERANCE).select("run_id", "seg_id", "f.place", "f.id")


def covering(wanted: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(run_id, seg_id, keyframe) of wanted (run_id, seg_id, at): the first keyframe whose own or covered time it is, else null.

    keyframes: run_id, place, id, t, and covered times as a list, ``covered``, or as ``spans``, a list of (first, step, n): n times, step seconds apart. Both may be there, or null."""
    own = F.array("t")
    if "covered" in keyframes.columns:
        own = F.array_union(own, F.coalesce("covered", F.array().cast("array<double>")))
    wanted = wanted.select("run_id", "seg_id", "at")
    met = _same_time(wanted, keyframes.select("run_id", "place", "id", F.explode(own).alias("t"))).select("run_id", "seg_id", "place", "id")
    if "spans" in keyframes.columns:
        met = met.unionByName(_in_spans(wanted, keyframes.select("run_id", "place", "id", F.inline("spans").alias("first", "step", "n"))))
    first = met.groupBy("run_id", "seg_id").agg(F.min(F.struct("place", "id")).alias("f"))
    return wanted.select("run_id", "seg_id").join(first, ["run_id", "seg_id"], "left").select("run_id", "seg_id", F.col("f.id").alias("keyframe"))


def times_within(windows: DataFrame, points: DataFrame, most: int = TIMES) -> DataFrame:
    """(run_id, window, side, times): the first ``most`` times of each side (run_id, side, t) within windows (run_id, window, low, high), bounds included."""
    spread = F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.greatest("low", "high") / BUCKET)))
    held = windows.select("run_id", "window", "low", "high", spread.alias("bucket")).join(points.withColumn("bucket", F.floor(F.col("t") / BUCKET)), ["run_id", "bucket"])
    order = Window.partitionBy("run_id", "window", "side").orderBy("t")
    first = held.where(F.col("t").between(F.col("low"), F.col("high"))).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return first.groupBy("run_id", "window", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.round("t", 3).alias("t")))), lambda x: x["t"]).alias("times"))


#: The sets of frames that a trace looks at, in the order of the stages.
SIDES = ("candidates", "initial", "pre_collapse", "final")


def limited(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of each run with their number ``k``, the run's whole count ``n_all`` and whether rows were left out, ``truncated``."""
    run = Window.partitionBy("run_id")
    first = rows.withColumn("k", F.row_number().over(run.orderBy(*order))).where(F.col("k") <= most)
    counted = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_all"))
    return first.join(counted, "run_id").withColumn("truncated", F.col("n_all") > most)


def trace_windows(low_content: DataFrame, boundaries: DataFrame, within: float) -> DataFrame:
    """Windows to trace, in order: each low-content decision, then each boundary that was joined against its reasons.

    low_content: run_id, number, at, selected (time of the fuller state or null), source (keyframes, covered_candidate,
    candidate_pool or null), matched. boundaries: run_id, number, at, selected, overridden (reasons)."""
    found = F.col("selected").isNotNull()
    pool, held = F.col("source") == "candidate_pool", F.col("source").isin("keyframes", "covered_candidate")
    no = F.lit(False)
    early = low_content.select(
        "run_id", F.lit(0).alias("part"), "number", F.format_string("auto_low_content_%03d", "number").alias("window"), F.col("at").alias("low"), (F.col("at") + within).alias("high"),
        "selected", "source", "matched",
        F.when(~found, "human_review_ambiguity").when(held, "group_boundary_miss").otherwise("initial_selection_miss").alias("cause"),
        F.when(found, "suppressed_for_later_fuller_state").otherwise("kept_without_fuller_state").alias("decision"),
        F.when(found, "low_content_lookahead").alias("repair"),
        (~found).alias("sampling_miss"), F.coalesce(pool, no).alias("initial_selection_miss"), F.coalesce(held, no).alias("group_boundary_miss"), F.lit(True).alias("low_content"),
    )
    joined = boundaries.where(F.size("overridden") > 0).select(
        "run_id", F.lit(1).alias("part"), "number", F.format_string("auto_boundary_override_%03d", "number").alias("window"), F.col("at").alias("low"), F.col("selected").alias("high"),
        "selected", F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("matched"),
        F.lit("group_boundary_miss").alias("cause"), F.lit("joined_by_title_continuity").alias("decision"), F.lit("title_continuity_override").alias("repair"),
        no.alias("sampling_miss"), no.alias("initial_selection_miss"), F.lit(True).alias("group_boundary_miss"), no.alias("low_content"),
    )
    return early.unionByName(joined)


def trace(windows: DataFrame, points: DataFrame, groups: DataFrame, most: int = 50) -> DataFrame:
    """What became of each window's selected state: where it was present, its collapse group and representative, the times of each stage.

    windows: from trace_windows(); points: run_id, side (one of SIDES), t; groups: run_id, group_no, t (of each member), representative (its time).
    ``most`` windows a run are traced, with the count of all. A state without a group stands for itself; present means within a millisecond."""
    traced = limited(windows, [F.col("part"), F.col("number")], most)
    selected = traced.where("selected IS NOT NULL").select("run_id", "window", F.col("selected").alias("at"))
    group = _same_time(selected, groups).groupBy("run_id", "window").agg(F.min(F.struct("group_no", "representative")).alias("g"))
    held = traced.join(group, ["run_id", "window"], "left").withColumn("stands", F.coalesce("g.representative", "selected"))
    stands = held.where("stands IS NOT NULL").select("run_id", "window", F.col("stands").alias("at"))
    present = _same_time(selected, points.where("side <> 'final'")).unionByName(_same_time(stands, points.where("side = 'final'")))
    present = present.groupBy("run_id", "window").agg(F.collect_set("side").alias("present"))
    times = times_within(traced, points).groupBy("run_id", "window").agg(*[F.max(F.when(F.col("side") == side, F.col("times"))).alias(f"{side}_times") for side in SIDES[:3]])
    none = F.array().cast("array<double>")
    out = held.join(present, ["run_id", "window"], "left").join(times, ["run_id", "window"], "left")
    moved = F.abs(F.col("matched") - F.col("stands")) >= TOLERANCE
    return out.select(
        "run_id", "k", "window", F.round("low", 3).alias("window_start"), F.round("high", 3).alias("window_end"), F.round("low", 3).alias("current_time"),
        *[F.coalesce(F.array_contains("present", side), F.lit(False)).alias(f"{side}_presence") for side in SIDES],
        *[F.coalesce(f"{side}_times", none).alias(f"{side}_times") for side in SIDES[:3]],
        F.col("g.group_no").alias("group_no"), F.col("source").alias("selected_source"), F.round("matched", 3).alias("matched_time"),
        F.when(moved, F.round("stands", 3)).alias("covering_representative_time"), F.round("stands", 3).alias("representative_time"),
        "cause", "decision", "repair", "sampling_miss", "initial_selection_miss", "group_boundary_miss", "low_content", F.col("selected").isNotNull().alias("fuller_state_found"), "n_all", "truncated",
    )


def keyframe_files(kept: DataFrame) -> DataFrame:
    """Kept frames (run_id, id, t) with their number in the run and the name of their file."""
    numbered = kept.withColumn("number", F.row_number().over(Window.partitionBy("run_id").orderBy("t", "id")))
    return numbered.withColumn("file", F.concat(F.format_string("keyframe_%04d_t", "number"), T.time_token(F.col("t")), F.lit(".jpg")))


#: Counters of a selection by decision, as :func:`tidemark.operators.folds.select_keyframes` names decisions.
COUNTERS = {
    "first_valid_frame_count": ("first_accepted_frame",),
    "difference_accepted_count": ("visual_difference_threshold",),
    "duplicate_rejected_count": ("duplicate_suppressed", "duplicate_fuller_state_update"),
    "duplicate_suppressed_count": ("duplicate_suppressed", "duplicate_fuller_state_update"),
    "quality_rejected_count": ("quality_rejected",),
    "stable_too_short_rejected_count": ("stable_too_short_rejected",),
    "low_difference_rejected_count": ("low_difference_rejected",),
    "fuller_state_update_count": ("duplicate_fuller_state_update", "low_difference_fuller_state_update"),
}


def selection_counts(decisions: DataFrame, most: int, samples: int = 25) -> DataFrame:
    """Each run's counters of decisions (run_id, id, t, decision), whether the number of keyframes was reached, and its first updates and rejected frames."""
    held = {name: F.count_if(F.col("decision").isin(*names)) for name, names in COUNTERS.items()}
    accepted = F.count_if(F.col("decision").isin("first_accepted_frame", "visual_difference_threshold"))
    counted = decisions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("scanned_frame_count"), F.count_if(F.col("decision") != "quality_rejected").alias("valid_frame_count"),
        *[c.alias(name) for name, c in held.items()], accepted.alias("stable_segment_count"), (accepted >= most).alias("max_keyframes_reached"),
    )

    def first(name: str, rule: Column) -> DataFrame:
        rows = limited(decisions.where(rule), [F.col("t"), F.col("id")], samples)
        return rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "t", "decision"))), lambda x: F.struct(x["id"].alias("id"), x["t"].alias("t"), x["decision"].alias("decision"))).alias(name))

    updates = first("update_samples", F.col("decision").endswith("fuller_state_update"))
    rejected = first("rejected_samples", F.col("decision") == "quality_rejected")
    return counted.join(updates, "run_id", "left").join(rejected, "run_id", "left")


def boundary_counts(boundaries: DataFrame) -> DataFrame:
    """Joins, breaks and a histogram of break reasons of each run's boundary decisions (run_id, reasons)."""
    counted = boundaries.groupBy("run_id").agg(F.count_if(F.size("reasons") == 0).alias("join_count"), F.count_if(F.size("reasons") > 0).alias("break_count"))
    each = boundaries.select("run_id", F.explode("reasons").alias("reason")).groupBy("run_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    histogram = each.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("break_reasons"))
    return counted.join(histogram, "run_id", "left")


def report(runs: DataFrame, parts: list[DataFrame], options: dict) -> DataFrame:
    """A report for each run (run_id, video_path, smoke_test, error_type, warnings, frame_count, ...) with the counts of parts, each a table of one row a run.

    A failed run keeps what was counted; counts that no part gives are 0. Warnings are distinct and sorted."""
    held = reduce(lambda a, b: a.join(b, "run_id", "left"), parts, runs)
    names = [f.name for f in held.schema if f.dataType.simpleString() == "bigint"]
    held = held.fillna(0, [name for name in names if name != "run_id"])
    failed = F.col("error_type").isNotNull()
    status = F.when(failed, "failed").when(F.coalesce("smoke_test", F.lit(False)), "smoke_success").otherwise("success")
    warnings = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("warnings", F.array().cast("array<string>")))))
    thresholds = ("min_frame_variance", "min_sharpness_score", "dark_frame_mean_threshold", "bright_frame_mean_threshold", "solid_frame_variance_threshold")
    settings = ("frame_interval_seconds", "max_keyframes", "min_visual_difference_score", "min_stable_duration_seconds", "duplicate_similarity_threshold", "duplicate_hash_distance_threshold", "animation_collapse_enabled")
    return held.withColumns({"status": status, "method": F.lit(METHOD), "warnings": warnings, "thresholds": F.struct(*[F.lit(options[n]).alias(n) for n in thresholds]), "settings": F.struct(*[F.lit(options[n]).alias(n) for n in settings])})


def segment_documents(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """Each run's visual segments (run_id, s, e, keyframe, ...) as one document; a failed run's is empty. runs: from report()."""
    names = [c for c in segments.columns if c not in ("run_id", "s")]
    held = segments.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("s", *names))).alias("segments"))
    kept = F.when(F.col("status") != "failed", F.col("segments"))
    kept = F.coalesce(kept, F.array().cast(held.schema["segments"].dataType))
    return runs.join(held, "run_id", "left").select("run_id", "video_path", "method", "status", kept.alias("segments"), F.size(kept).cast("long").alias("segment_count"), "error_type")


def changed_sources(before: DataFrame, now: DataFrame) -> DataFrame:
    """(run_id, name) of the sources (run_id, name, sha256) that changed, came or went between two readings; none where a stage's inputs held still."""
    both = before.withColumnRenamed("sha256", "was").join(now.withColumnRenamed("sha256", "is"), ["run_id", "name"], "full")
    return both.where(~F.col("was").eqNullSafe(F.col("is"))).select("run_id", "name")


def source_hashes(files: DataFrame) -> DataFrame:
    """files (run_id, name, content) with content's SHA-256."""
    return files.select("run_id", "name", F.sha2("content", 256).alias("sha256"))
