"""Artifacts of runs: JSON documents in, tables, JSON lines and Markdown out."""

from __future__ import annotations

import ntpath
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, allow_smoke: bool = True) -> DataFrame:
    """Whole-file JSON objects; a file that is none fails the read, a smoke-test file too unless allowed."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not allow_smoke:
        smoke = F.contains(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit(".smoke."))
        rows = rows.where(F.when(smoke, F.raise_error(F.lit("smoke-test file among the inputs")).cast("boolean")).otherwise(True))
    return rows


def latest_file(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The newest file below path whose name fits the pattern; only file listings are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first().path


def write_runs(df: DataFrame, path: str) -> None:
    """A table by run; the runs that df holds are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_prompt_pack(units: DataFrame, path: str) -> None:
    """One JSON line a unit, nulls written out."""
    units.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def prompt_pack_path(run_dir: str, configured: str) -> str:
    """Where a prompt pack may be written: a .jsonl file below the run's audit folder."""
    if "\0" in configured or ntpath.splitdrive(configured)[0] or posixpath.isabs(configured.replace("\\", "/")):
        raise ValueError(f"not a relative path: {configured!r}")
    audit = posixpath.join(posixpath.normpath(run_dir), "audit")
    path = posixpath.normpath(posixpath.join(run_dir, configured.replace("\\", "/")))
    if not path.startswith(f"{audit}/") or not path.endswith(".jsonl"):
        raise ValueError(f"not a .jsonl file below {audit}: {configured!r}")
    return path


def with_acquisition(metadata: DataFrame, report: DataFrame) -> DataFrame:
    """Run metadata with the acquisition report's columns as a struct; runs without a report keep a null one."""
    names = [c for c in report.columns if c != "run_id"]
    return metadata.drop("acquisition").join(report.select("run_id", F.struct(*names).alias("acquisition")), "run_id", "left")
