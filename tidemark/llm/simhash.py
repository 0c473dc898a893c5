"""Near-duplicates by SimHash fingerprints, found with covering locality-sensitive hashing.

Each of the 64 bit places gets a vector of RADIUS + 1 bits that is not zero. For each
non-zero vector v of that length, a mask takes the places whose vector has odd product
with v. The places in which two fingerprints differ span RADIUS dimensions at most if
there are RADIUS of them at most, so some v is orthogonal to all of them: under its
mask the two are equal. Every pair within the radius so meets in one of the
2^(RADIUS+1) - 1 tables, for certain.

Fingerprints are brought down to distinct ones first, so copies cost nothing. The
members of a bucket are compared in blocks of at most BLOCK against blocks of at most
BLOCK, and only the links of a spanning forest leave a block, never all pairs.

Fingerprints: a text's words, A-Z lower-cased, in windows of ``width``, repeats
included; a bit is set if it is set in over half of the windows' XXH64. Fewer words
than the width make one window, none make fingerprint zero, which links like any other.
Null text has no words. A component's id is its smallest doc_id that is not null.
Repeated rows share a fingerprint and a component. A very long text is hashed whole, its
windows as one array of longs. An empty table gives no rows. Columns besides doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, joined_to_facts, saved, text_of, words
from .components import components

BLOCK = 1024


def masks(radius: int, bits: int = 64) -> list[int]:
    """The masks, as signed 64-bit integers."""
    n = (1 << (radius + 1)) - 1
    place = [1 + 7 * i % n for i in range(bits)]
    out = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(bits) if (place[i] & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def window_hashes(held: Column, width: int) -> Column:
    """XXH64 (seed 42) of each window of width words of an array; held must be a column that is there, not an expression."""
    names, n = [chr(97 + k) for k in range(width)], F.size(held)
    zipped = F.arrays_zip(*[(held if k == 0 else F.slice(held, k + 1, F.greatest(n, F.lit(1)))).alias(name) for k, name in enumerate(names)])
    each = F.transform(F.slice(zipped, 1, F.greatest(n - (width - 1), F.lit(0))), lambda x: F.xxhash64(F.concat_ws(" ", *[x[name] for name in names])))
    return F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", held)))).otherwise(F.array().cast("array<bigint>"))


def _majority(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of 64-bit hashes."""
    out = np.zeros(len(starts) - 1, np.uint64)
    for k in range(len(out)):
        h = values[starts[k] : starts[k + 1]]
        if len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 65_536):
                part = np.ascontiguousarray(h[at : at + 65_536])
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fingerprint (a signed long) of each row of docs."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(ascii_lower(text_of())).alias("w"))
    hashed = held.select("doc_id", window_hashes(F.col("w"), width).alias("hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
            starts = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_majority(values, starts).view(np.int64))], ["doc_id", "fingerprint"])

    return hashed.mapInArrow(run, "doc_id long, fingerprint long")


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (seed, member) that join every component of members under the radius, found breadth first."""
    links, rest = [], members
    while len(rest) > 1:
        seed, rest, open_ = rest[0], rest[1:], [rest[0]]
        while open_ and len(rest):
            near = np.bitwise_count(rest ^ open_.pop()) <= radius
            if near.any():
                found = rest[near]
                links += [(int(seed), int(x)) for x in found]
                open_ += list(found)
                rest = rest[~near]
    return links


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) of fingerprints within the radius: enough of them that components are those of all such pairs. distinct: one row a fingerprint."""
    tables = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("key")) for t, mask in enumerate(masks(radius))])
    keyed = distinct.select("fingerprint", F.explode(tables).alias("k")).select("fingerprint", "k.*")
    crowded = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark sizes an explode like the table before it: without the hint it sends all tables of some 10 MB of fingerprints to the driver
    members = keyed.hint("merge").join(crowded, ["t", "key"])
    # blocks of a large bucket: every pair of blocks, and each with itself, is compared once
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    pairs = F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))))
    groups = members.select("t", "key", "fingerprint", F.explode(pairs).alias("p")).groupBy("t", "key", "p").agg(F.collect_list("fingerprint").alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
            found: list[tuple[int, int]] = []
            two = starts[:-1][np.diff(starts) == 2]
            close = two[np.bitwise_count(values[two] ^ values[two + 1]) <= radius]
            found += zip(values[close].tolist(), values[close + 1].tolist(), strict=True)
            for k in np.flatnonzero(np.diff(starts) > 2):
                found += forest(values[starts[k] : starts[k + 1]], radius)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, path: str, width: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id of each row of docs. path: a new folder that all executors share."""
    prints = saved(fingerprints(docs, width), f"{path}/fingerprints")
    distinct = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), f"{path}/distinct")
    labels = components(links(distinct, radius), f"{path}/components")
    joined = distinct.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    named = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = saved(joined.join(named, "label").select("fingerprint", "component_id", "copies"), f"{path}/classes")
    # rows of one fingerprint (every empty text, every copy) are dealt over tasks where they are many
    return joined_to_facts(prints, classes, ["fingerprint"], prints.count()).select("doc_id", "fingerprint", "component_id")


def hexadecimal(fingerprint: str = "fingerprint") -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
