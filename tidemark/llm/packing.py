"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Every document's ids are cut at multiples of the capacity, and each piece is dealt
to a group by a hash. A group is packed by itself: full pieces are sequences of their
own, the others go by falling length, each into the first open sequence that still
holds it, found by walking a tournament tree whose nodes keep the largest free
capacity below them. There is a group for each GROUP_BYTES of text and each
GROUP documents, so what a group holds is bounded whatever the documents' lengths.

A null or empty text is a document of the end id alone. Repeated rows are packed
as often as they occur; rows are dealt by their place in a task too, so that equal
ones spread over the groups. Ties in length go by doc_id, then start. An empty table
gives no pieces. Columns besides doc_id and text are not read. The pieces of a very
long document spread over many groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, pieces_of

#: Documents and bytes of text in a group, on average.
GROUP, GROUP_BYTES = 4000, 8_000_000


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given, with first fit; every length is 1 to capacity."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= length
        while node > 1:
            node //= 2
            best = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of the ids of (doc_id, text) with their end: doc_id, start, length, doc_tokens, row (the document's place in its task), wide and ids.

    ids are unsigned 16-bit integers where a piece's ids are below 65,536, and 32-bit ones where wide. Encoded and cut in one
    pass, so that a task has one Python process."""
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "row", "wide", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = encoder(vocabulary), 0
        for batch in batches:
            at = 0
            for part in pieces_of(batch.column(1)):
                rows = []
                for doc_id, packed in zip(batch.column(0).slice(at, len(part)).to_pylist(), code.texts(part), strict=True):
                    ids = np.frombuffer(packed + end, "<u4")
                    wide = bool(ids.max() >= 1 << 16)
                    held = ids if wide else ids.astype("<u2")
                    for k in range(0, len(ids), capacity):
                        piece = held[k : k + capacity]
                        rows.append((doc_id, k, len(piece), len(ids), row, wide, piece.tobytes()))
                    row += 1
                at += len(part)
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    held = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return held.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, row long, wide boolean, ids binary")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, seed: int = 11) -> DataFrame:
    """Pieces of all documents with sequence_id, offset and their ids (unsigned 32-bit little-endian)."""
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("size")).first()
    groups = max(1, round(seen.n / GROUP), round((seen.size or 0) / GROUP_BYTES))
    dealt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "start", "row"), F.lit(groups))
    pieces = cut(docs, vocabulary, end_id, capacity).withColumn("group", dealt)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        lengths = group["length"].to_numpy()
        full = int((lengths == capacity).sum())
        bins, offsets = first_fit(lengths[full:].tolist(), capacity)
        bins = np.concatenate((np.arange(full), full + np.array(bins, np.int64)))
        group["sequence_id"] = group["group"].to_numpy(np.int64) * (1 << 32) + bins
        group["offset"] = np.concatenate((np.zeros(full, np.int64), np.array(offsets, np.int64)))
        group["ids"] = [x if wide else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, wide in zip(group["ids"], group["wide"], strict=True)]
        return group[["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]]

    kinds = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return pieces.groupBy("group").applyInPandas(run, kinds)
