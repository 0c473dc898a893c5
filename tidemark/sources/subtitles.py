"""Subtitle files (WebVTT, SubRip) as cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import captions

#: Lines that start so, in any case, are headers and not speech.
HEADERS = r"(?i)^\s*(WEBVTT|NOTE|STYLE|REGION)"


#: Stands for the end of a line while markup is stripped; a private character, no white space.
LINE = "\ue000"


def cues(lines: DataFrame, keep_numbers: bool = False, keep_lines: bool = False) -> DataFrame:
    """(file, number, start, end, text) of lines (file, content): the text of a cue runs to the next timing line, its lines joined by spaces or kept.

    A line of digits alone just before a timing line is the next cue's number and goes, unless ``keep_numbers``."""
    flat = F.replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    rows = lines.select("file", F.posexplode(F.split(F.regexp_replace(flat, "^\ufeff", ""), "\n")).alias("at", "line"))
    held = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    timing = F.filter("l", lambda x: F.contains(x["line"], F.lit("-->")))
    each = held.withColumn("t", timing).select("file", "l", "t", F.posexplode("t").alias("k", "cue"))
    until = F.coalesce(F.get("t", F.col("k") + 1)["at"], F.size("l"))
    body = F.filter(F.slice("l", F.col("cue.at") + 2, F.greatest(until - F.col("cue.at") - 1, F.lit(0))), lambda x: ~x["line"].rlike(HEADERS))
    if not keep_numbers:
        last = until - 1
        body = F.filter(body, lambda x: ~(x["line"].rlike(r"^\s*\d+\s*$") & (x["at"] >= last - 1) & (F.col("k") < F.size("t") - 1)))
    text = T.strip_markup(F.array_join(F.transform(body, lambda x: T.strip(x["line"])), f" {LINE} "))
    text = F.array_join(F.filter(F.transform(F.split(text, LINE), T.strip), lambda x: x != ""), "\n" if keep_lines else " ")
    times = F.split("cue.line", "-->")
    first = lambda k: F.get(F.split(T.strip(F.get(times, F.lit(k))), r"\s+"), F.lit(0))
    found = each.select("file", (F.col("k") + 1).alias("number"), T.parse_timestamp(first(0)).alias("start"), T.parse_timestamp(first(1)).alias("end"), text.alias("text"))
    return found.where("text <> ''")


def segments(lines: DataFrame, **options) -> DataFrame:
    """Cues as transcript segments: without lines that the cue before has shown, and without segments that a neighbour holds; numbered anew."""
    held = cues(lines, keep_lines=True, **options)
    rows = held.select(F.col("file").alias("run_id"), F.col("number").alias("seg_id"), "text")
    kept = captions.without_redundant(captions.rolling(rows)).withColumnsRenamed({"run_id": "file", "number": "position"})
    times = held.select("file", F.col("number").alias("seg_id"), "start", "end")
    return kept.join(times, ["file", "seg_id"]).select("file", F.col("position").alias("number"), "start", "end", "text")


def read(spark: SparkSession, path: str, raw: bool = False, **options) -> DataFrame:
    """Transcript segments of every subtitle file below path, by Spark's own readers; raw: its cues as they are."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return cues(files, **options) if raw else segments(files, **options)
