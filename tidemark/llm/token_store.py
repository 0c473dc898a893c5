"""Token ids in binary shards: one zstandard dictionary for all, one frame for each document.

A store is a folder with three Parquet tables:

* ``dictionary``: the dictionary's bytes and their SHA-256, trained on a bounded
  sample of serialized id arrays: of the SAMPLE rows of the smallest hashes of doc_id
  the first SAMPLE_CHARS characters, SAMPLE_IDS ids at most. The sample is repeated
  where a small table holds too little to train on; without any row the dictionary is
  empty and frames are compressed without one;
* ``blocks``: rows of (shard, block, first_doc_id, last_doc_id, n_docs, n_tokens, before,
  content); before counts the ids of the shard's earlier blocks. Content is
  a self-contained binary block of at most about BLOCK_BYTES of frames::

      magic "TDMK", version u16, id width u16, dictionary SHA-256 (32 bytes), documents u32
      index: documents x (doc_id i64, frame offset u64, frame length u32, ids u32)
      frames: documents x one zstandard frame of that document's ids, little-endian

* ``manifest``: documents and ids of each shard, and the ids of all shards before it.

Shards hold ascending ranges of doc_id and blocks ascend within a shard, so a short
document is read by one block and one frame. Null doc_ids come first; equal doc_ids
follow one another, ordered by their text's hash. A null text is an empty one, with
the end id alone. A very long text is one frame, in a block that it may overfill.
An empty table gives a store without blocks. Columns besides doc_id and text are not
read, so their names cannot clash. The same rows give the same store.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for
from .tokens import encoder, pieces_of

MAGIC, VERSION = b"TDMK", 1
HEAD = "<4sHH32sI"
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
SAMPLE, SAMPLE_IDS, SAMPLE_CHARS, DICTIONARY_BYTES, BLOCK_BYTES = 2000, 2048, 16_384, 65_536, 4_000_000
#: Documents of a shard, about.
SHARD = 20_000
#: Up to so many shards the manifest is broadcast to the blocks (24 bytes a shard); beyond it is joined.
BROADCAST_SHARDS = 500_000
BLOCK_NAMES = ["shard", "block", "first_doc_id", "last_doc_id", "n_docs", "n_tokens", "before", "content"]
BLOCK_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
BLOCK = "shard int, block int, first_doc_id long, last_doc_id long, n_docs long, n_tokens long, before long, content binary"
NO_ID = -(2**63)  # stands for a null doc_id within a block


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, vocabulary: str, width: int) -> bytes:
    """Dictionary bytes from the sample; empty without any row."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # ids first: texts are then read for the sample alone. Where ids repeat, the texts' hashes decide
    chosen = docs.select("doc_id").orderBy(*order).limit(SAMPLE).select(F.col("doc_id").alias("chosen")).distinct()
    sample = docs.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")
    sample = sample.select("doc_id", F.xxhash64("text").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    sample = sample.orderBy(*order, "h").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            for part in pieces_of(batch.column(0)):
                ids = [np.frombuffer(x, "<u4")[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for x in code.texts(part)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    samples = sorted(bytes(row.ids) for row in sample.select("text").mapInArrow(run, "ids binary").collect() if row.ids)  # SAMPLE rows at most
    if not samples:
        return b""
    times = max(1, -(-8 * DICTIONARY_BYTES // sum(map(len, samples))), -(-64 // len(samples)))
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples * times, k=256, d=8).as_bytes()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int = 2) -> None:
    """Writes doc_id and text of every row as a store at path. width: bytes of an id, 2 or 4; a larger id is refused."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trained = train_dictionary(docs, vocabulary, width)
    digest = hashlib.sha256(trained).digest()
    spark.createDataFrame([(digest.hex(), bytearray(trained))], "sha256 string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, block = encoder(vocabulary), TaskContext.get().partitionId(), 0
        compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(trained), write_content_size=True)
        frames: list[bytes] = []
        entries: list[tuple] = []
        at = before = 0

        def close() -> pa.RecordBatch:
            nonlocal before
            head = struct.pack(HEAD, MAGIC, VERSION, width, digest, len(entries)) + np.array(entries, ENTRY).tobytes()
            n_tokens = sum(e[3] for e in entries)
            row = (shard, block, entries[0][0], entries[-1][0], len(entries), n_tokens, before, head + b"".join(frames))
            before += n_tokens
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, BLOCK_KINDS, strict=True)], BLOCK_NAMES)

        for batch in batches:
            ids_of, row = batch.column(0).to_pylist(), 0
            for part in pieces_of(batch.column(1)):
                for packed in code.texts(part):
                    ids = np.append(np.frombuffer(packed, "<u4"), np.uint32(end_id))
                    if int(ids.max()) >= 1 << (8 * width):
                        raise ValueError(f"id {ids.max()} does not fit into {width} bytes")
                    frame = compressor.compress(ids.astype(f"<u{width}").tobytes())
                    doc_id = ids_of[row]
                    entries.append((NO_ID if doc_id is None else doc_id, at, len(frame), len(ids)))
                    frames.append(frame)
                    at, row = at + len(frame), row + 1
                    if at >= BLOCK_BYTES:
                        yield close()
                        frames, entries, at, block = [], [], 0, block + 1
        if entries:
            yield close()

    shards = partitions_for(spark, docs.count(), SHARD)
    ordered = docs.withColumns({"__h": F.xxhash64("text"), "__n": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(shards, "doc_id", "__h", "__n").sortWithinPartitions("doc_id", "__h", "__n")
    blocks = ordered.select("doc_id", "text").mapInArrow(run, BLOCK)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard
    totals = totals.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    totals.coalesce(1).write.parquet(f"{path}/manifest")


def _open(content: bytes, digest: bytes) -> tuple[int, np.ndarray, int]:
    magic, version, width, held, n = struct.unpack_from(HEAD, content)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token block")
    if held != digest:
        raise ValueError("the block was written with another dictionary")
    return width, np.frombuffer(content, ENTRY, n, struct.calcsize(HEAD)), struct.calcsize(HEAD) + n * ENTRY.itemsize


def _load_dictionary(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row.content)
    if hashlib.sha256(content).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not have its hash")
    return content, bytes.fromhex(row.sha256)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit little-endian)."""
    content, digest = _load_dictionary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        for batch in batches:
            for first, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = block.as_py()
                width, index, frames = _open(data, digest)
                starts = first + np.concatenate(([0], np.cumsum(index["n_tokens"].astype(np.int64))))
                for at in range(0, len(index), 1000):
                    part = index[at : at + 1000]
                    at_of = [frames + int(offset) for offset in part["offset"]]
                    ids = [decompressor.decompress(data[a : a + int(n)]) for a, n in zip(at_of, part["length"], strict=True)]
                    ids = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in ids]
                    doc_ids = pa.array(part["doc_id"], pa.int64(), mask=part["doc_id"] == NO_ID)
                    columns = [doc_ids, pa.array(starts[at : at + len(part)], pa.int64()), pa.array(part["n_tokens"].astype(np.int64)), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "base")
    if manifest.count() <= BROADCAST_SHARDS:
        manifest = F.broadcast(manifest)
    blocks = spark.read.parquet(f"{path}/blocks").join(manifest, "shard")
    return blocks.select((F.col("base") + F.col("before")).alias("first"), "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of each row of one doc_id: the blocks whose range holds it are opened, and only its frames decompressed."""
    content, digest = _load_dictionary(spark, path)
    decompressor, found = zstandard.ZstdDecompressor(dict_data=_dictionary(content)), []
    inside = (F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)
    for row in spark.read.parquet(f"{path}/blocks").where(inside).orderBy("shard", "block").toLocalIterator():
        data = bytes(row.content)
        width, index, frames = _open(data, digest)
        for e in index[index["doc_id"] == doc_id]:
            at = frames + int(e["offset"])
            found.append(np.frombuffer(decompressor.decompress(data[at : at + int(e["length"])]), f"<u{width}").tolist())
    return found
