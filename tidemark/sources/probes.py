"""Probe and download documents as VARIANT: what a recording's streams are, whatever shape the JSON has drifted to.

A document is parsed once, by ``try_parse_json``; fields are read with ``try_variant_get``, so a
field that is missing or of another kind is null, and a document that is none, or without a video
stream, is a row with a ``warning``, never an error. Numbers that came as text count as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import resolution
from ..functions.text import strip

# Fixed values of the format
FAILED, INVALID, NO_VIDEO = "ffprobe failed.", "ffprobe returned invalid JSON", "ffprobe found no video stream."
NO_PATH = "No video path was available."
ENVIRONMENT_MARKERS = ("javascript runtime", "js runtime")


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _first(items: Column, kind: str) -> Column:
    return F.get(F.filter(items, lambda x: text_at(x, "$.codec_type") == kind), F.lit(0))


def resolution_payload(width: Column, height: Column, warning: Column) -> Column:
    """A struct of width, height, resolution and warning."""
    return F.struct(width.alias("width"), height.alias("height"), resolution(width, height).alias("resolution"), warning.alias("warning"))


def video_metadata(probes: DataFrame) -> DataFrame:
    """probes with ``video``: available, width, height, vcodec, acodec and warning of the first video and the first audio stream.

    probes: run_id, body (the probe's JSON), return_code, message (what it said; nulls count as none), and others."""
    held = probes.withColumn("__v", F.try_parse_json("body"))
    held = held.withColumn("__s", F.coalesce(F.try_variant_get("__v", "$.streams", "array<variant>"), F.array().cast("array<variant>")))
    held = held.withColumns({"__video": _first(F.col("__s"), "video"), "__audio": _first(F.col("__s"), "audio")})
    failed = F.coalesce(F.col("return_code") != 0, F.lit(False))
    said = F.coalesce(F.nullif(strip(F.col("message")), F.lit("")), F.lit(FAILED))
    # a document that says nothing is an empty one
    invalid = F.col("__v").isNull() & (F.coalesce(F.length(strip(F.col("body"))), F.lit(0)) > 0)
    warning = F.when(failed, said).when(invalid, INVALID).when(F.col("__video").isNull(), NO_VIDEO)
    of = lambda value: F.when(~failed, value)
    video = F.struct(
        F.lit(True).alias("available"),
        of(F.try_variant_get("__video", "$.width", "long")).alias("width"),
        of(F.try_variant_get("__video", "$.height", "long")).alias("height"),
        of(text_at(F.col("__video"), "$.codec_name")).alias("vcodec"),
        of(text_at(F.col("__audio"), "$.codec_name")).alias("acodec"),
        warning.alias("warning"),
    )
    return held.select(*[f"`{c}`" for c in probes.columns], video.alias("video"))


def video_resolution(probed: DataFrame) -> DataFrame:
    """run_id and its video's resolution payload. probed: from video_metadata(), with video_path."""
    no = F.col("video_path").isNull()
    of = lambda name: F.when(~no, F.col(f"video.{name}"))
    return probed.select("run_id", resolution_payload(of("width"), of("height"), F.when(no, NO_PATH).otherwise(F.col("video.warning"))).alias("resolution"))


def requested_formats(downloads: DataFrame) -> DataFrame:
    """downloads (run_id, body: what the downloader says of a recording, and others) with format_id, the requested formats' ids joined by a plus sign or the whole's, and format: width, height, vcodec and acodec of the first requested format with video, else of the whole."""
    held = downloads.withColumn("__v", F.try_parse_json("body"))
    held = held.withColumn("__f", F.try_variant_get("__v", "$.requested_formats", "array<variant>"))
    ids = F.array_compact(F.transform("__f", lambda x: text_at(x, "$.format_id")))
    whole = text_at(F.col("__v"), "$.format_id")
    format_id = F.when(F.coalesce(F.size("__f"), F.lit(0)) > 0, F.when(F.size(ids) > 0, F.array_join(ids, "+"))).otherwise(whole)
    shown = F.get(F.filter("__f", lambda x: F.coalesce(text_at(x, "$.vcodec"), F.lit("none")) != "none"), F.lit(0))
    held = held.withColumn("__one", F.coalesce(shown, F.col("__v")))
    one = F.struct(*[F.try_variant_get("__one", f"$.{c}", kind).alias(c) for c, kind in (("width", "long"), ("height", "long"), ("vcodec", "string"), ("acodec", "string"))])
    return held.select(*[f"`{c}`" for c in downloads.columns], format_id.alias("format_id"), one.alias("format"))


def environment_warnings(messages: Column) -> Column:
    """Of an array of messages those about the downloader's runtime, distinct and sorted."""
    lowered = lambda x: F.lower(x)
    about = lambda x: F.contains(lowered(x), F.lit(ENVIRONMENT_MARKERS[0])) | F.contains(lowered(x), F.lit(ENVIRONMENT_MARKERS[1]))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(messages, F.array().cast("array<string>")), about)))


def download_reports(downloads: DataFrame, preferred_height: int) -> DataFrame:
    """A report for each run: its formats, what was asked for and what came, and whether a lower resolution was taken.

    downloads: from requested_formats(), joined to ``video`` of video_metadata(), with video_path and messages (array of texts)."""
    width = F.coalesce(F.col("video.width"), F.col("format.width"))
    height = F.coalesce(F.col("video.height"), F.col("format.height"))
    below = F.coalesce(height < preferred_height, F.lit(False))
    unknown = height.isNull()
    status = F.when(F.col("video_path").isNull(), "failed").when(below | unknown, "degraded").otherwise("success")
    warning = F.when(unknown, F.coalesce(F.col("video.warning"), F.lit("The video's resolution is not known."))).when(below, F.format_string("The video's height is below the preferred %d.", F.lit(preferred_height)))
    return downloads.select(
        "run_id",
        F.when(F.col("video_path").isNull(), "failed").otherwise("success").alias("status"),
        status.alias("acquisition_status"),
        "video_path",
        "format_id",
        F.coalesce("video.vcodec", "format.vcodec").alias("vcodec"),
        F.coalesce("video.acodec", "format.acodec").alias("acodec"),
        F.lit(preferred_height).alias("requested_preferred_height"),
        width.alias("actual_video_width"),
        height.alias("actual_video_height"),
        resolution(width, height).alias("downloaded_resolution"),
        below.alias("resolution_fallback_used"),
        warning.alias("resolution_warning"),
        environment_warnings(F.col("messages")).alias("environment_warnings"),
    )


def acquisition(reports: DataFrame) -> DataFrame:
    """The part of download reports that a run's metadata take over; see :func:`artifacts.with_acquisition`."""
    names = {"acquisition_status": "status", "requested_preferred_height": "requested_preferred_height", "actual_video_width": "actual_video_width", "actual_video_height": "actual_video_height", "downloaded_resolution": "actual_video_resolution"}
    same = ("resolution_fallback_used", "resolution_warning", "environment_warnings")
    return reports.select("run_id", *[F.col(c).alias(name) for c, name in names.items()], *same)
