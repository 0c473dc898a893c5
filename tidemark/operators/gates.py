"""Fail-closed gates: what a run must satisfy before its transcript is aligned or its content mapped.

Everything is a table by run: a run that breaks a rule gets a failed report with the
first rule's error, keeps the counts that were computed, and has no other output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import timeline

#: Share of the transcript's end that the visual side must reach.
LEAST_COVERAGE = 0.8
METHOD = "transcript_visual_time_alignment_v1"


def violations(rows: DataFrame, rules: list[tuple[str, Column]], ordinal: int) -> DataFrame:
    """(run_id, ordinal, pos, error_type) of every rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(ordinal + k).alias("ordinal"), F.lit(name).alias("error_type"))) for k, (name, rule) in enumerate(rules)]))
    return rows.select("run_id", "pos", F.explode(broken).alias("v")).select("run_id", "v.ordinal", "pos", "v.error_type")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with id replaced by pos + 1 where it is null or 0."""
    return rows.withColumn("id", F.when(F.col("id").isNull() | (F.col("id") == 0), F.col("pos") + 1).otherwise(F.col("id")))


def blank(column: str) -> Column:
    return F.coalesce(strip(F.col(column)), F.lit("")) == ""


def alignment_violations(runs: DataFrame, transcript: DataFrame, visual: DataFrame) -> DataFrame:
    """All violations, in the order of the checks. runs: run_id, status, smoke_test; transcript: run_id, pos, s, e, text; visual: run_id, pos, s, e, keyframe_path."""
    bad_times = [(F.col("s").isNull() | F.col("e").isNull()), (F.col("s") >= F.col("e"))]
    t = violations(transcript, [("InvalidTranscriptSegment", bad_times[0] | blank("text")), ("InvalidTimeline", bad_times[1])], 20)
    v = violations(visual, [("InvalidVisualSegment", bad_times[0] | blank("keyframe_path")), ("InvalidTimeline", bad_times[1])], 30)
    spans = timeline.coverage(transcript.withColumn("seg_id", F.col("pos")), visual.withColumn("seg_id", F.col("pos")))
    held = runs.join(spans, "run_id", "left").join(visual.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_visual")), "run_id", "left").withColumn("pos", F.lit(-1).cast("long"))
    r = violations(held, [("MissingRawTranscript", F.col("transcript_end").isNull()), ("MissingVisualSegments", F.col("n_visual").isNull()), ("MissingFrameReport", F.col("status").isNull())], 0)
    late = violations(held, [("VisualEvidenceIsSmoke", F.coalesce("smoke_test", F.lit(False))), ("MissingFrameReport", F.col("status") != "success"), ("VisualCoverageTooShort", F.col("visual_end") < LEAST_COVERAGE * F.col("transcript_end"))], 40)
    return reduce(DataFrame.unionByName, [r, t, v, late])


def first_errors(found: DataFrame) -> DataFrame:
    """(run_id, error_type, pos) of each failed run's first violation."""
    first = found.groupBy("run_id").agg(F.min(F.struct("ordinal", "pos", "error_type")).alias("f"))
    return first.select("run_id", F.col("f.error_type").alias("error_type"), F.col("f.pos").alias("error_pos"))


def align_runs(runs: DataFrame, transcript: DataFrame, visual: DataFrame, nearest: int = 30) -> tuple[DataFrame, DataFrame]:
    """(alignment, reports): alignments of the runs that pass, a report for every run."""
    errors = first_errors(alignment_violations(runs, transcript, visual))
    passed = runs.join(errors, "run_id", "left_anti").select("run_id")
    t = numbered(transcript).withColumn("seg_id", F.col("pos")).join(passed, "run_id", "left_semi")
    v = numbered(visual).withColumns({"seg_id": F.col("id"), "idx": F.col("pos"), "at": F.col("s")}).join(passed, "run_id", "left_semi")
    aligned = timeline.align(t, v, nearest, max(nearest, 60)).withColumnsRenamed({"seg_id": "transcript_index", "visual_id": "matched_visual_segment_id"})
    counts = aligned.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("confidence") == "none").alias("unaligned_count"), F.count_if(F.col("confidence") == "low").alias("low_confidence_count"))
    size = lambda rows, name: rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    reports = runs.select("run_id").join(errors, "run_id", "left").join(counts, "run_id", "left").join(size(transcript, "n_transcript"), "run_id", "left").join(size(visual, "n_visual"), "run_id", "left")
    spans = timeline.coverage(transcript.withColumn("seg_id", F.col("pos")), visual.withColumn("seg_id", F.col("pos")))
    end_ratio = F.round(F.try_divide("visual_end", "transcript_end"), 6).alias("end_ratio")
    spans = spans.select("run_id", F.struct(*[c for c in spans.columns if c != "run_id"], end_ratio).alias("coverage"))
    gap = lambda rows, side: timeline.gaps(rows.withColumn("seg_id", F.col("pos"))).withColumnsRenamed({"gap_count": f"{side}_gap_count", "max_gap": f"largest_{side}_gap"})
    gaps = gap(transcript, "transcript").join(gap(visual, "visual"), "run_id", "left")
    gaps = gaps.select("run_id", F.struct(*[c for c in gaps.columns if c != "run_id"]).alias("gap_summary"))
    reports = reports.join(spans, "run_id", "left").join(gaps, "run_id", "left")
    failed, none = F.col("error_type").isNotNull(), F.lit(0).cast("long")
    warnings = F.array_compact(F.array(F.when(F.col("unaligned_count") > 0, "some transcript segments are unaligned"), F.when(F.col("low_confidence_count") > 0, "some alignments have low confidence")))
    return aligned, reports.select(
        "run_id",
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.lit(METHOD).alias("method"),
        "error_type",
        "error_pos",
        F.coalesce("n_transcript", none).alias("transcript_count"),
        F.coalesce("n_visual", none).alias("visual_count"),
        (F.col("n_rows") - F.col("unaligned_count")).alias("aligned_count"),
        "unaligned_count",
        "low_confidence_count",
        "coverage",
        F.when(~failed, F.col("gap_summary")).alias("gap_summary"),
        F.coalesce(F.when(~failed, warnings), F.array().cast("array<string>")).alias("warnings"),
    )


def content_map_violations(reports: DataFrame, aligned: DataFrame, transcript: DataFrame, visual: DataFrame, runs: DataFrame | None = None, lost_keyframes: DataFrame | None = None) -> DataFrame:
    """Runs whose alignment may not be mapped: not a success, of another method, unknown or repeated ids, transcript rows without partner, low confidence.

    runs: run_id, frame_status, visual_status, smoke_test; where it is given, a run that it lacks, that is of a smoke test or did not succeed may not be mapped
    either. lost_keyframes: run_id, seg_id of segments whose keyframe file is not there, from inventory.missing_keyframes()."""
    r = violations(reports.withColumn("pos", F.lit(-1).cast("long")), [("AlignmentFailed", F.col("status") != "success"), ("AlignmentMethodUnknown", F.col("method") != METHOD)], 0)
    known_t = transcript.select("run_id", F.col("pos").alias("transcript_index"), F.lit(True).alias("t"))
    known_v = numbered(visual).select("run_id", F.col("id").alias("matched_visual_segment_id"), F.lit(True).alias("v")).distinct()
    held = aligned.join(known_t, ["run_id", "transcript_index"], "left").join(known_v, ["run_id", "matched_visual_segment_id"], "left").withColumn("pos", F.col("transcript_index"))
    a = violations(held, [("UnknownTranscriptSegment", F.col("t").isNull()), ("UnknownVisualSegment", F.col("v").isNull()), ("LowConfidence", F.col("confidence").isin("low", "none"))], 10)
    lost = known_t.join(aligned, ["run_id", "transcript_index"], "left_anti").withColumn("pos", F.col("transcript_index"))
    again = lambda rows: numbered(rows).groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos"))
    twice = violations(again(visual), [("DuplicateVisualSegment", F.col("n") > 1)], 30).unionByName(violations(again(transcript), [("DuplicateTranscriptSegment", F.col("n") > 1)], 31))
    found = [r, a, violations(lost, [("TranscriptNotAligned", F.lit(True))], 20), twice]
    if runs is not None:
        given = reports.select("run_id").join(runs, "run_id", "left").withColumn("pos", F.lit(-1).cast("long"))
        done = lambda c: F.coalesce(F.col(c) == "success", F.lit(False))
        found.append(violations(given, [("SmokeInputs", F.coalesce("smoke_test", F.lit(False))), ("FrameReportFailed", ~done("frame_status")), ("VisualSegmentsFailed", ~done("visual_status"))], -10))
    if lost_keyframes is not None:
        found.append(violations(lost_keyframes.select("run_id", F.col("seg_id").alias("pos")), [("MissingKeyframe", F.lit(True))], 5))
    return reduce(DataFrame.unionByName, found)
