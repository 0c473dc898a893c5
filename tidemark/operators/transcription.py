"""Which runs still need a transcription, and the reports and transcripts of those that got one.

Everything is a table by run; speech recognition itself is a connector whose segments come as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

BACKEND = "faster-whisper"


def _present(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def gate(runs: DataFrame, options: dict, forced: bool = False) -> DataFrame:
    """A report for each run: ``ready`` to be transcribed, or skipped or failed for the first reason that holds.

    runs: run_id, has_transcript, has_download_report, download_status, video_path (as reported), found_video (an existing
    file), has_subtitle_report, fallback_required; nulls count as absent. options: from options.transcription(). A smoke
    test (of the first seconds) that is forced passes over an existing transcript and a fallback that is not required."""
    smoke = options["transcription_smoke_seconds"]
    insist = F.lit(bool(forced and smoke is not None))
    backend = options["transcription_backend"]
    found, reported = strip(F.col("found_video")), F.nullif(strip(F.col("video_path")), F.lit(""))
    steps = [
        (_present("has_transcript") & ~insist, "skipped", "raw_transcript_exists"),
        (~_present("has_download_report"), "failed", "MissingDownloadReport"),
        (~F.coalesce(F.col("download_status") == "success", F.lit(False)), "failed", "DownloadFailed"),
        (~_present("has_subtitle_report"), "failed", "MissingSubtitleReport"),
        (~_present("fallback_required") & ~insist, "skipped", "fallback_not_required"),
        (found.isNull(), "failed", "MissingVideo"),
        (F.lit(backend != BACKEND), "failed", "UnsupportedBackend"),
    ]
    verdict = F.lit(None).cast("struct<status:string,why:string>")
    for rule, status, why in reversed(steps):
        verdict = F.when(rule, F.struct(F.lit(status).alias("status"), F.lit(why).alias("why"))).otherwise(verdict)
    status = F.coalesce(F.col("verdict.status"), F.lit("ready"))
    # before the download report is read, no path is known
    known = ~F.coalesce(F.col("verdict.why"), F.lit("")).isin("raw_transcript_exists", "MissingDownloadReport")
    names = {"backend": "backend", "model": "model", "device": "device", "compute_type": "compute_type", "language": "configured_language"}
    return runs.withColumn("verdict", verdict).select(
        "run_id",
        status.alias("status"),
        F.when(known, F.coalesce(found, reported)).alias("video_path"),
        *[F.lit(options[f"transcription_{key}"]).cast("string").alias(name) for key, name in names.items()],
        F.lit(None).cast("string").alias("detected_language"),
        F.lit(0).cast("long").alias("segment_count"),
        F.lit(smoke is not None).alias("smoke_test"),
        F.lit(smoke).cast("double").alias("smoke_seconds"),
        F.when(status == "failed", F.col("verdict.why")).alias("error_type"),
        F.when(status == "skipped", F.col("verdict.why")).alias("skip_reason"),
    )


def reports(gated: DataFrame, segments: DataFrame) -> DataFrame:
    """gated with the outcome of its ready runs: success (smoke_success for a smoke test) where segments (run_id, language, ...) came, else failed."""
    found = segments.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("language").alias("language"))
    ready = F.col("status") == "ready"
    held = gated.join(found, "run_id", "left")
    none = ready & F.col("n").isNull()
    return held.select(
        "run_id",
        F.when(none, "failed").when(ready & F.col("smoke_test"), "smoke_success").when(ready, "success").otherwise(F.col("status")).alias("status"),
        *[c for c in gated.columns if c not in ("run_id", "status", "detected_language", "segment_count", "error_type", "skip_reason")],
        F.when(ready, F.col("language")).alias("detected_language"),
        F.when(ready, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("segment_count"),
        F.when(none, "NoTimedSegments").otherwise(F.col("error_type")).alias("error_type"),
        "skip_reason",
    )


def transcripts(done: DataFrame) -> DataFrame:
    """The head of a transcript for each run that was transcribed; its segments stay a table by run. Smoke tests are marked, for they must not pass as formal ones."""
    source = F.struct(
        F.lit("faster_whisper_fallback").alias("type"),
        "model",
        F.coalesce("configured_language", "detected_language").alias("language"),
        "video_path",
        "smoke_test",
        "smoke_seconds",
    )
    kept = done.where(F.col("status").isin("success", "smoke_success"))
    return kept.select("run_id", source.alias("source"), F.lit(True).alias("fallback_required"), F.lit("Subtitle fallback transcription.").alias("fallback_reason"), "segment_count")


def subtitle_transcripts(chosen: DataFrame, segments: DataFrame) -> DataFrame:
    """The head of a transcript for each run whose subtitles were taken. chosen: run_id, source (automatic or manual), language, subtitle_path."""
    automatic = F.coalesce(F.col("source") == "automatic", F.lit(False))
    source = F.struct(F.when(automatic, "automatic_subtitle").otherwise("platform_subtitle").alias("type"), "language", "subtitle_path", automatic.alias("is_auto_generated"))
    n = segments.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    held = chosen.select("run_id", source.alias("source")).join(n, "run_id", "left")
    return held.select("run_id", "source", F.lit(False).alias("fallback_required"), F.lit(None).cast("string").alias("fallback_reason"), F.coalesce("n", F.lit(0)).alias("segment_count"))
