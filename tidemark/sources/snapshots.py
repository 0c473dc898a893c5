"""Published snapshots of a job's outputs: all of a version are there, or none.

    version = snapshots.begin(spark, root)
    snapshots.add(version, "keyframes", keyframes)      # a table; any number of them
    documents.write(rows, version.path("documents"))    # files of runs
    snapshots.publish(version)                          # readers see it from here on
    snapshots.table(spark, root, "keyframes")

A version is a folder of its own below ``root/versions``. Publishing swaps one small file,
``root/current``, which names the version, by a rename over the old one; readers go by that
file. A job that ends in the middle leaves a folder that nothing names: readers still see the
old set whole, or nothing where none was published. :func:`vacuum` removes folders but the
current one and those after it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class NotPublished(LookupError):
    """There is no snapshot, or it lacks the output."""


@dataclass(frozen=True)
class Version:
    spark: SparkSession
    root: str
    name: str

    def path(self, output: str) -> str:
        return f"{self.root}/versions/{self.name}/{output}"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    held = hadoop.Path(path)
    return hadoop, held, held.getFileSystem(spark._jsc.hadoopConfiguration())


def begin(spark: SparkSession, root: str) -> Version:
    """A new version; nobody sees it before it is published."""
    return Version(spark, root.rstrip("/"), f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")


def add(version: Version, output: str, table: DataFrame, by_run: bool = False) -> DataFrame:
    """Writes a table of the version, and reads it back."""
    writer = table.write.mode("overwrite")
    (writer.partitionBy("run_id") if by_run else writer).parquet(version.path(output))
    return version.spark.read.schema(table.schema).parquet(version.path(output))


def publish(version: Version) -> None:
    """From now on readers see this version, whole."""
    spark = version.spark
    hadoop, folder, system = _files(spark, f"{version.root}/versions/{version.name}")
    outputs = sorted(x.getPath().getName() for x in system.listStatus(folder)) if system.exists(folder) else []
    if not outputs:
        raise NotPublished(f"version {version.name} has no output")
    draft = hadoop.Path(f"{version.root}/.current-{version.name}")
    out = system.create(draft, True)
    try:
        out.write(bytearray(json.dumps({"version": version.name, "outputs": outputs}).encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(system.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(draft), system.makeQualified(hadoop.Path(f"{version.root}/current")), over)


def current(spark: SparkSession, root: str) -> dict:
    """The version and outputs of the published snapshot."""
    root = root.rstrip("/")
    _, path, system = _files(spark, f"{root}/current")
    if not system.exists(path):
        raise NotPublished(f"nothing is published in {root}")
    return json.loads(spark.read.option("wholetext", True).text(f"{root}/current").first().value)


def path_of(spark: SparkSession, root: str, output: str) -> str:
    """Where an output of the published snapshot lies."""
    held = current(spark, root)
    if output not in held["outputs"]:
        raise NotPublished(f"the snapshot in {root} has no {output}")
    return Version(spark, root.rstrip("/"), held["version"]).path(output)


def table(spark: SparkSession, root: str, output: str) -> DataFrame:
    """A table of the published snapshot."""
    return spark.read.parquet(path_of(spark, root, output))


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes the versions before the current one; how many. Later ones may be being written."""
    now = current(spark, root)["version"]
    _, folder, system = _files(spark, f"{root.rstrip('/')}/versions")
    old = [x.getPath() for x in system.listStatus(folder) if x.getPath().getName() < now]
    for path in old:
        system.delete(path, True)
    return len(old)
