"""Command line: ``python -m tidemark subtitles|align|visual|content-map|outline``, each a Spark job from tables to tables.

* ``subtitles IN OUT`` parses subtitle files into a table of cues.
* ``align RUNS TRANSCRIPT VISUAL OUT`` runs the gates, aligns the runs that pass and
  writes ``alignment`` (by run) and ``reports``; the exit code is 1 if any run failed.
* ``visual SETTINGS RUNS FRAMES OUT`` selects keyframes and publishes ``keyframes``, ``segments``,
  ``trace``, ``boundaries``, ``reports`` and ``documents``; the exit code is 1 if any run failed.
* ``content-map SETTINGS ALIGNED TRANSCRIPT VISUAL FEATURES OUT`` (ALIGNED: the output of
  ``align``) publishes ``units``, ``requests``, ``review_reports``, ``outlines`` and the rest,
  and below ``files`` each run's documents; the exit code is 1 if a run was refused.
* ``transcribe SETTINGS RUNS SEGMENTS OUT`` gates runs, takes what was recognized of those that are
  ready, and publishes ``reports``, ``transcripts`` and, below ``files``, the transcript and report of
  each run; the exit code is 1 if any run failed.
* ``download-reports SETTINGS DOWNLOADS PROBES OUT`` publishes ``reports``, ``acquisition`` and files.
* ``inventory ROOT OUT`` lists the files of all runs below ROOT.
* ``outline UNITS OUT`` writes a Markdown outline for each run.

What is published is one snapshot below OUT (see :mod:`tidemark.sources.snapshots`): all of it is
there, or what was there before.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import jobs
from .operators import gates, reports
from .sources import artifacts, config, documents, inventory, options, snapshots, subtitles


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__.splitlines()[0])
    parts = out.add_subparsers(dest="job", required=True)
    held = parts.add_parser("subtitles")
    held.add_argument("source")
    held.add_argument("out")
    held.add_argument("--keep-numbers", action="store_true", help="keep SubRip cue numbers in the text")
    held = parts.add_parser("align")
    for name in ("runs", "transcript", "visual", "out"):
        held.add_argument(name)
    held.add_argument("--nearest", type=int, default=30, help="seconds within which a nearest segment still matches")
    held = parts.add_parser("visual")
    for name in ("settings", "runs", "frames", "out"):
        held.add_argument(name)
    held.add_argument("--frame-interval", type=float)
    held.add_argument("--smoke-seconds", type=float)
    held.add_argument("--max-keyframes", type=int)
    held = parts.add_parser("content-map")
    for name in ("settings", "aligned", "transcript", "visual", "features", "out"):
        held.add_argument(name)
    held = parts.add_parser("transcribe")
    for name in ("settings", "runs", "segments", "out"):
        held.add_argument(name)
    held.add_argument("--smoke-seconds", type=float)
    held.add_argument("--force", action="store_true", help="transcribe the first seconds even where a transcript is there or not required")
    held = parts.add_parser("download-reports")
    for name in ("settings", "downloads", "probes", "out"):
        held.add_argument(name)
    held = parts.add_parser("inventory")
    held.add_argument("root")
    held.add_argument("out")
    held = parts.add_parser("outline")
    held.add_argument("units")
    held.add_argument("out")
    return out


def published(spark: SparkSession, tables: dict[str, DataFrame], out: str, files: DataFrame | None = None) -> None:
    """One snapshot of all tables, and of the files (run_id, name, body) of runs."""
    version = snapshots.begin(spark, out)
    for name, table in tables.items():
        snapshots.add(version, name, table)
    if files is not None:
        documents.write(files, version.path("files"))
    snapshots.publish(version)


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"tidemark {a.job}").getOrCreate()
    if a.job == "subtitles":
        subtitles.read(spark, a.source, keep_numbers=a.keep_numbers).write.mode("overwrite").parquet(a.out)
    elif a.job == "visual":
        found = options.visual(config.load(a.settings), a.frame_interval, a.smoke_seconds, a.max_keyframes)
        got = jobs.visual(spark.read.parquet(a.runs), spark.read.parquet(a.frames), found, f"{a.out}/work")
        published(spark, got, a.out, jobs.visual_documents(got))
        return int(not snapshots.table(spark, a.out, "reports").where("status = 'failed'").isEmpty())
    elif a.job == "content-map":
        paths = (f"{a.aligned}/alignment", f"{a.aligned}/reports", a.transcript, a.visual, a.features)
        found = options.content_map(config.load(a.settings))
        got = jobs.content_maps(*[spark.read.parquet(p) for p in paths], found)
        published(spark, got, a.out, jobs.content_map_documents(got, found))
        return int(not snapshots.table(spark, a.out, "errors").isEmpty())
    elif a.job == "transcribe":
        found = options.transcription(config.load(a.settings), a.smoke_seconds)
        got = jobs.transcriptions(spark.read.parquet(a.runs), spark.read.parquet(a.segments), found, a.force)
        published(spark, {k: got[k] for k in ("reports", "transcripts")}, a.out, got["files"])
        return int(not snapshots.table(spark, a.out, "reports").where("status = 'failed'").isEmpty())
    elif a.job == "download-reports":
        got = jobs.downloads(spark.read.parquet(a.downloads), spark.read.parquet(a.probes), options.acquisition(config.load(a.settings)))
        published(spark, {k: got[k] for k in ("reports", "acquisition")}, a.out, got["files"])
        return int(not snapshots.table(spark, a.out, "reports").where("status = 'failed'").isEmpty())
    elif a.job == "inventory":
        inventory.listing(spark, a.root).write.mode("overwrite").parquet(a.out)
    elif a.job == "outline":
        reports.outline(spark.read.parquet(a.units)).write.mode("overwrite").parquet(a.out)
    else:
        aligned, held = gates.align_runs(*[spark.read.parquet(p) for p in (a.runs, a.transcript, a.visual)], a.nearest)
        artifacts.write_runs(aligned, f"{a.out}/alignment")
        held.write.mode("overwrite").parquet(f"{a.out}/reports")
        return int(spark.read.parquet(f"{a.out}/reports").where("status = 'failed'").limit(1).count() > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
