"""WARC archives of page captures, and the assembly of their records into transactions.

Every capture is three records of one archive: a response (or a revisit, where a
later capture holds the same payload), a request and a metadata record, the latter
two with the first one's id in WARC-Concurrent-To. An archive is a ``.warc.gz`` file that
begins with a warcinfo record; each record is a gzip member of its own, so that it can be
read by its offset, and a file is closed once it holds FILE_BYTES. Archives are read back
a member at a time.

The tasks of one Spark stage write the archives, each to a name of its own attempt, and
report what they wrote; only reported files are listed in the archive table, so that what
a lost executor left behind is not read. Readers take files by that list.

Of captures with equal payloads of at least ``least`` bytes that with the largest
page_id answers (of repeated rows of it, one), the others revisit it. A null payload
is empty, a null url is written as ``urn:none``, line ends in a url are percent-encoded.
A null page_id has no page-id field and reads back as null. A very long payload is one
record. An empty table gives no archives and reads back empty. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import joined_to_facts, saved

#: A file is closed beyond so many bytes.
FILE_BYTES = 32_000_000
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, uri string, concurrent_to string, refers_to string, digest string, fields map<string,string>, payload binary"
_NAMES = ("record_id", "type", "uri", "concurrent_to", "refers_to", "digest")
_ARROW = pa.schema([(n, pa.string()) for n in _NAMES] + [("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Placed in every record, so that equal captures give equal archives.
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def captures(pages: DataFrame, path: str, least: int) -> DataFrame:
    """page_id, uri, payload, digest, bytes, same (a hash of the payload), answers (its record is the one revisits refer to), revisit and top (the answer's page_id)."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:none")), "\r", "%0D"), "\n", "%0A").alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    base = base.withColumns({"bytes": F.octet_length("payload").cast("long"), "same": F.md5("payload")})
    large = base.where(F.col("bytes") >= least).groupBy("same", "page_id").agg(F.count(F.lit(1)).alias("n"))
    facts = large.groupBy("same").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("copies")).where("copies > 1")
    facts = saved(facts.select("same", F.col("top.page_id").alias("top"), F.col("top.n").alias("n_top"), "copies"), f"{path}/copies")
    # small payloads meet nothing: a key of their own keeps equal ones apart
    alone = F.concat(F.lit("alone"), F.monotonically_increasing_id().cast("string"))
    keyed = base.withColumn("same", F.when(F.col("bytes") >= least, F.col("same")).otherwise(alone))
    held = joined_to_facts(keyed, facts, ["same"], pages.count(), "left")
    at_top = F.col("page_id").eqNullSafe(F.col("top"))
    answers = F.col("n_top").isNotNull() & at_top
    if facts.where("n_top > 1").limit(1).count():  # repeated rows of an answering page: one of them answers
        order = Window.partitionBy("same", "page_id").orderBy("uri")
        held = held.withColumn("k", F.row_number().over(order))
        answers = answers & (F.col("k") == 1)
    return held.select("page_id", "uri", "payload", F.sha1("payload").alias("digest"), "bytes", "same", answers.alias("answers"), (F.col("n_top").isNotNull() & ~answers).alias("revisit"), "top")


def _urn(*of: object) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(repr(of).encode()).hexdigest())}>"


def member(kind: str, record_id: str, content_type: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in headers] + [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, wbits=31)
    return b"".join((packer.compress("\r\n".join(lines).encode() + END), packer.compress(block), packer.compress(END), packer.flush()))


def qualified(spark: SparkSession, path: str) -> str:
    """path as Spark resolves it: where it has no scheme, with that of the default file system, so that archives lie where tables do."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toString()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path in it."""
    return (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Writes (page_id, url, html) as .warc.gz files below path, and the table of those files."""
    held, archives = captures(pages, path, least), f"{qualified(pages.sparkSession, path)}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(archives)
        store.create_dir(folder, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, name, size, n_records, n_files, row = None, "", 0, 0, 0, 0
        done: list[tuple[str, int, int]] = []

        def put(record: bytes) -> None:
            nonlocal size, n_records
            out.write(record)
            size, n_records = size + len(record), n_records + 1

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7, 8)]
            for k, (page_id, uri, digest, n_bytes, same, answers, revisit, top) in enumerate(zip(*columns, strict=True)):
                if out is None:
                    name, size, n_records, n_files = f"part-{task:05d}-{n_files:05d}-{attempt}.warc.gz", 0, 0, n_files + 1
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    put(member("warcinfo", _urn("info", name), "application/warc-fields", b"format: WARC File Format 1.1\r\n", [("WARC-Filename", name)]))
                record_id = _urn("answer", same) if answers else _urn("capture", attempt, task, row)
                target, with_it = [("WARC-Target-URI", uri)], [("WARC-Target-URI", uri), ("WARC-Concurrent-To", record_id)]
                fields = ([] if page_id is None else [f"page-id: {page_id}"]) + [f"payload-bytes: {n_bytes}"]
                block, headers = HEAD % n_bytes, [*target, ("WARC-Payload-Digest", f"sha1:{digest}")]
                if revisit:
                    headers += [("WARC-Refers-To", _urn("answer", same)), ("WARC-Profile", PROFILE)]
                    fields += [] if top is None else [f"answering-page-id: {top}"]
                else:
                    block += batch.column(2)[k].as_py().encode()
                put(member("request", _urn("request", record_id), "application/http; msgtype=request", f"GET {uri} HTTP/1.1\r\n\r\n".encode(), with_it))
                put(member("revisit" if revisit else "response", record_id, "application/http; msgtype=response", block, headers))
                put(member("metadata", _urn("metadata", record_id), "application/warc-fields", "".join(f"{x}\r\n" for x in fields).encode(), with_it))
                row += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, n_records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n_records, size))
        names, records, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["file", "n_records", "n_bytes"])

    held.mapInArrow(run, "file string, n_records long, n_bytes long").write.parquet(f"{path}/files")


def members(data: io.BufferedIOBase, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, held one at a time."""
    rest, at = data.read(step), 0
    while rest:
        unpacker, out, begin = zlib.decompressobj(wbits=31), [], at
        while not unpacker.eof:
            out.append(unpacker.decompress(rest))
            at += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data or data.read(step)
            if not rest and not unpacker.eof:
                raise ValueError("the archive ends within a record")
        yield begin, b"".join(out)


def parse(record: bytes) -> dict:
    """One record."""
    end = record.index(END)
    version, *lines = record[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    kind, payload, fields = head["warc-type"], None, {}
    if kind == "response":
        payload = block[block.index(END) + 4 :]
    elif kind in ("metadata", "warcinfo"):
        fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
    names = ("warc-record-id", "warc-type", "warc-target-uri", "warc-concurrent-to", "warc-refers-to", "warc-payload-digest")
    return dict(zip(_NAMES, map(head.get, names), strict=True)) | {"fields": list(fields.items()), "payload": payload}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the listed archives below path but their warcinfo records."""
    listed = spark.read.parquet(f"{path}/files")
    n = listed.count()
    if not n:
        return spark.createDataFrame([], RECORD)
    archives = f"{qualified(spark, path)}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(archives)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[dict] = []
                size = 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as data:
                    for _, record in members(data):
                        rows.append(parse(record))
                        size += len(record)
                        if size >= 4_000_000:
                            yield pa.RecordBatch.from_pylist([r for r in rows if r["type"] != "warcinfo"], _ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist([r for r in rows if r["type"] != "warcinfo"], _ARROW)

    tasks = min(n, 4 * spark.sparkContext.defaultParallelism + n // 16)
    return listed.select("file").repartition(tasks).mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: its id, and its response (or revisit), request and metadata records nested, joined by concurrent-to ids.

    A request or metadata record that names no capture of these records is left out. records may lack columns that the
    caller has dropped (payload, say) and may have more."""
    nested = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    kind = F.col("type")

    def one(of: Column) -> Column:
        return F.first(F.when(of, F.col("record")), ignorenulls=True)

    held = records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), kind, nested.alias("record"))
    held = held.groupBy("capture_id").agg(
        one(kind.isin("response", "revisit")).alias("response"), one(kind == "request").alias("request"), one(kind == "metadata").alias("metadata")
    )
    return held.where(F.col("response").isNotNull())
