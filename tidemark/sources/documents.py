"""A sink for the documents of runs: one JSON, JSON-lines, Markdown or binary file for each row, by a two-phase commit.

    documents.write(rows, path)      # rows: run_id, name, body
    rows.write.format("run_documents").option("path", path).mode("append").save()   # once registered

A row's body goes to ``path/<run_id>/<name>``. A task writes to a folder of its own attempt and
moves its files into place when it has written all of them; a task that fails takes its folder
away, so it leaves no file. When all tasks have told the driver what they have moved, the driver
writes ``path/_SUCCESS`` with the number of files. When the job fails, it removes what the tasks
that ended had moved, and there is no ``_SUCCESS``. A file of the same name is replaced.

Bodies: a name that ends in ``.json`` is written with an indent of two, anything else as it is;
``.json``, ``.jsonl`` and ``.md`` end in one line break. A null body writes no file. A name
must be relative and stay below its run; run ids are taken as text.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

TEXT = (".json", ".jsonl", ".md")


def qualified(spark: SparkSession, path: str) -> str:
    """path as Spark resolves it: with the default file system's scheme where it has none."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toString()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def body_of(name: str, body: str | bytes) -> bytes:
    """The bytes of a file: JSON indented, text with one line break at its end."""
    if not name.endswith(TEXT):
        return body if isinstance(body, bytes) else body.encode()
    text = body.decode() if isinstance(body, bytes) else body
    if name.endswith(".json"):
        text = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    return (text.rstrip() + "\n").encode()


def place_of(run_id: str, name: str) -> str:
    """Where a row's file lies below the sink's path."""
    for part in (run_id, name):
        if not part or posixpath.isabs(part) or "\0" in part or "\\" in part or ".." in part.split("/") or part.startswith(("_", ".")):
            raise ValueError(f"not a name below a run: {part!r}")
    return f"{run_id}/{posixpath.normpath(name)}"


@dataclass
class Moved(WriterCommitMessage):
    """Files that a task has moved into place."""

    places: list[str]


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        system, root = opened(self.path)
        own, places = f"{root}/_attempt-{uuid.uuid4().hex}", []
        try:
            for batch in iterator:
                for run_id, name, body in zip(*(batch.column(c).to_pylist() for c in ("run_id", "name", "body")), strict=True):
                    if body is None:
                        continue
                    place = place_of(str(run_id), name)
                    system.create_dir(posixpath.dirname(f"{own}/{place}"), recursive=True)
                    with system.open_output_stream(f"{own}/{place}") as out:
                        out.write(body_of(name, body))
                    places.append(place)
            for place in places:
                system.create_dir(posixpath.dirname(f"{root}/{place}"), recursive=True)
                system.move(f"{own}/{place}", f"{root}/{place}")
        finally:
            if places or system.get_file_info(own).type != fs.FileType.NotFound:
                system.delete_dir(own)
        return Moved(places)

    def commit(self, messages: list[Moved | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(sum(len(m.places) for m in messages if m)).encode())

    def abort(self, messages: list[Moved | None]) -> None:
        system, root = opened(self.path)
        for message in messages:
            for place in message.places if message else []:
                if system.get_file_info(f"{root}/{place}").type == fs.FileType.File:
                    system.delete_file(f"{root}/{place}")


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_documents"

    def schema(self) -> str:
        return "run_id string, name string, body string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write(rows: DataFrame, path: str) -> None:
    """A file for each row (run_id, name, body: text or binary) below path."""
    spark = rows.sparkSession
    spark.dataSource.register(Documents)
    body = F.col("body") if dict(rows.dtypes)["body"] == "binary" else F.col("body").cast("string")
    held = rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("name").cast("string").alias("name"), body.alias("body"))
    held.write.format("run_documents").option("path", qualified(spark, path)).mode("append").save()


def as_json(rows: DataFrame, name: str | Column, fields: list[str | Column] | None = None) -> DataFrame:
    """(run_id, name, body): each row's fields (all by default) as a JSON object, nulls written out."""
    held = F.struct(*(fields or [f"`{c}`" for c in rows.columns]))
    return rows.select("run_id", (F.lit(name) if isinstance(name, str) else name).alias("name"), F.to_json(held, {"ignoreNullFields": "false"}).alias("body"))


def as_lines(rows: DataFrame, name: str | Column, order: str) -> DataFrame:
    """(run_id, name, body): each run's rows as JSON lines in order, nulls written out."""
    lines = rows.select("run_id", F.struct(F.col(order).alias("o"), F.to_json(F.struct(*[f"`{c}`" for c in rows.columns if c != order or order in rows.columns]), {"ignoreNullFields": "false"}).alias("line")).alias("x"))
    held = lines.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    return held.select("run_id", (F.lit(name) if isinstance(name, str) else name).alias("name"), "body")


def raw_transcripts(heads: DataFrame, segments: DataFrame) -> DataFrame:
    """The transcript document of each run of heads (run_id, source, fallback_required, fallback_reason, ...), its segments (run_id, pos, s, e, text) inside.

    That of a smoke test has ``.smoke`` in its name, so that it never passes for a formal one."""
    item = F.struct(F.col("pos"), F.col("s").alias("start_time"), F.col("e").alias("end_time"), "text")
    held = segments.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    held = held.select("run_id", F.transform("segments", lambda x: x.dropFields("pos")).alias("segments"))
    rows = heads.drop("segment_count", "segments").join(held, "run_id", "left")
    rows = rows.withColumn("segments", F.coalesce("segments", F.array().cast(held.schema["segments"].dataType))).withColumn("segment_count", F.size("segments"))
    has = "smoke_test" in heads.schema["source"].dataType.names
    smoke = F.coalesce(F.col("source.smoke_test"), F.lit(False)) if has else F.lit(False)
    return as_json(rows, F.when(smoke, "audit/raw_transcript.smoke.json").otherwise("audit/raw_transcript.json"))


def keyframe_files(keyframes: DataFrame, images: DataFrame) -> DataFrame:
    """(run_id, name, body): the bytes of each keyframe (run_id, id, file) from images (run_id, id, content), under its numbered name. A keyframe without an image writes none."""
    return keyframes.join(images, ["run_id", "id"]).select("run_id", F.concat(F.lit("assets/keyframes/"), "file").alias("name"), F.col("content").alias("body"))


def run_metadata(runs: DataFrame, created_at: Column | None = None) -> DataFrame:
    """The first document of each run (run_id, video_url, output_dir, output_language, ...): what it was set up with."""
    held = runs.withColumns({"created_at": F.date_format(created_at if created_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "status": F.lit("initialized")})
    return as_json(held, "audit/run_metadata.json")
