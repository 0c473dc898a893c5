"""What files runs have, as one table of a single listing; no file's content is read.

    files = inventory.listing(spark, root)            # run_id, name, file, suffix, path, modified, length
    inventory.subtitle_files(files, wanted)           # by precedence
    inventory.video_files(files, reported)
    inventory.missing_inputs(files, runs, inventory.CONTENT_MAP_INPUTS)

Precedence is a rank, and the file of a run is a minimum over (rank, newest first, path): a
map-side aggregate, for all runs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed values of the format: where a run has its inputs
ALIGNMENT_INPUTS = {"raw_transcript_path": "audit/raw_transcript.json", "visual_segments_path": "audit/visual_segments.json", "frame_report_path": "audit/frame_report.json", "keyframe_dir": "assets/keyframes"}
CONTENT_MAP_INPUTS = {"raw_transcript": "audit/raw_transcript.json", "visual_segments": "audit/visual_segments.json", "frame_report": "audit/frame_report.json", "alignment": "audit/alignment.json"}
SUBTITLES, UNFINISHED = (".srt", ".vtt"), (".part", ".ytdl")


def described(files: DataFrame) -> DataFrame:
    """files (run_id, name, path, modified, length) with ``file``, the last part of name, and ``suffix``, lower-cased."""
    last = F.element_at(F.split("name", "/"), -1)
    suffix = F.lower(F.regexp_extract(last, r"(\.[^.]*)$", 1))
    return files.select("run_id", "name", last.alias("file"), suffix.alias("suffix"), "path", "modified", "length")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """run_id (the folder below root), name (the path in it), file, suffix, path, modified and length of each file."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/") + "/"
    below = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    parts = held.select(F.split(below, "/", 2).alias("p"), "path", F.col("modificationTime").alias("modified"), "length")
    return described(parts.where("size(p) = 2").select(F.col("p")[0].alias("run_id"), F.col("p")[1].alias("name"), "path", "modified", "length"))


def best(files: DataFrame, rank: Column) -> DataFrame:
    """(run_id, path): of each run's files with a rank the one of the least, the newest of equals, then the first by path."""
    key = F.struct(rank.alias("rank"), (-F.unix_micros(F.col("modified").cast("timestamp"))).alias("age"), F.col("path"))
    return files.withColumn("__rank", rank).where("__rank IS NOT NULL").groupBy("run_id").agg(F.min(key)["path"].alias("path"))


def subtitle_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, path) for each of wanted (run_id, video_id, language): ``<video_id>.<language>.*`` before any other of the language; null where there is none."""
    held = files.where(F.col("suffix").isin(*SUBTITLES)).join(wanted, "run_id")
    own = F.startswith("file", F.concat("video_id", F.lit("."), "language", F.lit(".")))
    some = F.contains("file", F.concat(F.lit("."), F.col("language"), F.lit(".")))
    return wanted.select("run_id").join(best(held, F.when(own, 0).when(some, 1)), "run_id", "left")


def video_files(files: DataFrame, reported: DataFrame) -> DataFrame:
    """(run_id, path, source) for each of reported (run_id, paths: an array, best first): the first that exists, else the newest file that is neither subtitle nor unfinished; null where there is none."""
    named = reported.select("run_id", F.posexplode(F.coalesce("paths", F.array().cast("array<string>"))).alias("place", "path")).where(strip(F.col("path")) != "")
    there = files.select("path", F.lit(True).alias("exists")).distinct()
    first = named.join(there, "path", "left_semi").groupBy("run_id").agg(F.min_by("path", "place").alias("told"))
    videos = files.where(~F.col("suffix").isin(*SUBTITLES, *UNFINISHED))
    newest = best(videos, F.lit(0)).withColumnRenamed("path", "newest")
    held = reported.select("run_id").join(first, "run_id", "left").join(newest, "run_id", "left")
    source = F.when(F.col("told").isNotNull(), "report").when(F.col("newest").isNotNull(), "newest")
    return held.select("run_id", F.coalesce("told", "newest").alias("path"), source.alias("source"))


def required(found: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """found (run_id, path, ...) parted into runs that have a path, and an error (run_id, type, message) for each that has none."""
    none = found.where("path IS NULL").select("run_id", F.lit("FileNotFoundError").alias("type"), F.lit(f"{what} was not found").alias("message"))
    return found.where("path IS NOT NULL"), none


def missing_inputs(files: DataFrame, runs: DataFrame, names: dict[str, str]) -> DataFrame:
    """(run_id, input, type, message) for each input that a run lacks; a folder is there if a file is below it. runs: run_id."""
    kinds = F.explode(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])).alias("input", "name")
    wanted = runs.select("run_id", kinds)
    have = files.select("run_id", "name").union(files.select("run_id", F.regexp_replace("name", "/[^/]*$", ""))).distinct()
    gone = wanted.join(have, ["run_id", "name"], "left_anti")
    return gone.select("run_id", "input", F.lit("FileNotFoundError").alias("type"), F.concat(F.lit("missing input: "), "name").alias("message"))


def missing_keyframes(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(run_id, seg_id, file): the segments whose keyframe has no file below the run's keyframe folder. segments: run_id, seg_id, file."""
    have = files.where(F.startswith("name", F.lit(ALIGNMENT_INPUTS["keyframe_dir"] + "/"))).select("run_id", "file").distinct()
    return segments.select("run_id", "seg_id", "file").join(have, ["run_id", "file"], "left_anti").select("run_id", "seg_id", "file")
