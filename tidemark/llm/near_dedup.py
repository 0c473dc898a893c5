"""One document of each near-duplicate group, for a similarity (Jaccard of word windows) of 0.8 or more.

SimHash at four bits, with the covering tables of :mod:`simhash`, brings together
copies that differ in very little; texts that are 0.8 alike differ in about ten bits of
64, which no affordable radius covers. Candidates therefore also come from 16 bands of
four MinHash values over the same windows. Within a bucket the signatures tell which
members are worth a look: the components of those that seem close. Of a small one all
close pairs are compared by their whole sets of windows. The members of a larger one
meet with their sets, and a member is taken into a spanning forest only after that
comparison, so that no text hides a link of another and never all pairs of a bucket
leave it. Only pairs of the similarity or more are links; groups are their components.

Texts without a word are copies of one another. Of each group the row of the smallest
doc_id stays (a null one last); of repeated rows, one. An empty table gives no rows.
Input columns are returned as they were, whatever their names. Texts are known by 128
bits (t). A very long text is hashed whole; its set of windows is one array of longs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved, text_of, words
from .components import components
from .simhash import _majority, links, window_hashes

HASHES, BANDS, ROWS, BLOCK = 128, 16, 4, 512
#: Of so many texts that seem close in a bucket, each pair is verified by a join; more are compared together.
FEW = 8
#: Signatures this much below the similarity are still worth a look: over twice the error of 128 hashes at 0.8.
SLACK = 0.08
LAST = 2**63 - 1


def signatures(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """MinHash signature (HASHES unsigned 32-bit values) of each run of 64-bit hashes."""
    factors = np.random.default_rng(17).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        least = np.full(HASHES, 2**32 - 1, np.uint32)
        for at in range(a, b, 4096):
            h = values[at : min(b, at + 4096)].view(np.uint64)
            least = np.minimum(least, ((h[:, None] * factors) >> np.uint64(32)).min(axis=0).astype(np.uint32))
        out.append(least.tobytes())
    return out


def close_groups(members: np.ndarray, least: float) -> list[list[int]]:
    """Places of the members of each component, of two or more, of the pairs that seem close. members: signatures in rows."""
    groups, rest = [], np.arange(len(members))
    while len(rest) > 1:
        group, rest, k = [int(rest[0])], rest[1:], 0
        while k < len(group) and len(rest):
            near = (members[rest] == members[group[k]]).mean(axis=1) >= least
            group += rest[near].tolist()
            rest = rest[~near]
            k += 1
        if len(group) > 1:
            groups.append(group)
    return groups


def linked_pairs(values: np.ndarray, starts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of pairs of the similarity or more that join every component of all such pairs. values: distinct hashes, a set from each start to the next."""
    ids = np.unique(values, return_inverse=True)[1].astype(np.int32)
    sizes, held = np.diff(starts), np.zeros(len(ids), np.int8)
    pairs, rest = [], np.arange(len(sizes))
    while len(rest) > 1:
        open_, rest = [int(rest[0])], rest[1:]
        while open_ and len(rest):
            x = open_.pop()
            own = ids[starts[x] : starts[x + 1]]
            held[own] = 1
            upto = np.concatenate(([0], np.cumsum(held[ids], dtype=np.int64)))
            held[own] = 0
            shared, both = (upto[starts[rest + 1]] - upto[starts[rest]]), sizes[rest] + sizes[x]
            alike = (both == 0) | (shared >= similarity * (both - shared))
            found = rest[alike].tolist()
            pairs += [(x, y) for y in found]
            open_ += found
            rest = rest[~alike]
    return pairs


def candidates(texts: DataFrame, similarity: float) -> DataFrame:
    """What is worth a look: pairs (a, b) of t where g is null, else a is a member of the group g. texts: t, sig."""
    width = 4 * ROWS
    bands = F.array(*[F.struct(F.lit(k).cast("short").alias("band"), F.xxhash64(F.substring("sig", 1 + k * width, width)).alias("key")) for k in range(BANDS)])
    keyed = texts.select("t", F.explode(bands).alias("k")).select("t", "k.*")
    crowded = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.hint("merge").join(crowded, ["band", "key"]).join(texts.select("t", "sig"), "t")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("t"), blocks).cast("int")
    pairs = F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))))
    groups = members.select("band", "key", "t", "sig", F.explode(pairs).alias("p")).groupBy("band", "key", "p").agg(F.collect_list(F.struct("t", "sig")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: list[tuple[bytes, bytes]] = []
            crowds: list[tuple[bytes, bytes]] = []
            for row in batch.column(0):
                held = row.values
                names = held.field("t").to_pylist()
                sigs = np.frombuffer(b"".join(held.field("sig").to_pylist()), "<u4").reshape(len(names), HASHES)
                for group in close_groups(sigs, similarity - SLACK):
                    if len(group) <= FEW:
                        alike = (sigs[group][:, None] == sigs[group]).mean(axis=2) >= similarity - SLACK
                        close = [(names[group[i]], names[group[j]]) for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True)]
                        pairs += [(min(p), max(p)) for p in close]
                    else:
                        inside = sorted(names[k] for k in group)
                        g = md5(b"".join(inside)).digest()
                        crowds += [(g, t) for t in inside]
            columns = [[None] * len(pairs) + [g for g, _ in crowds], [x for x, _ in pairs] + [t for _, t in crowds], [y for _, y in pairs] + [None] * len(crowds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["g", "a", "b"])

    return groups.select("members").mapInArrow(run, "g binary, a binary, b binary").distinct()


def marks(docs: DataFrame, width: int) -> DataFrame:
    """t (the text's hash), doc_id, fp and sig of each row of docs."""
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text_of().alias("text"))
    held = held.select("doc_id", F.unhex(F.md5("text")).alias("t"), words(ascii_lower(F.col("text"))).alias("w"))
    held = held.select("doc_id", "t", window_hashes(F.col("w"), width).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column(2)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
                starts = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
                prints = pa.array(_majority(values, starts).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), prints, pa.array(signatures(values, starts), pa.binary())], ["doc_id", "t", "fp", "sig"])

    return held.mapInArrow(run, "doc_id long, t binary, fp long, sig binary")


def similar(docs: DataFrame, texts: DataFrame, pairs: DataFrame, crowds: DataFrame, width: int, similarity: float, path: str) -> DataFrame:
    """(a, b) of texts whose sets of windows have at least the similarity: all such pairs, and of each group g of crowds (g, t) enough to join its components. texts: t, doc_id."""
    ends = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).union(crowds.select("t")).distinct()
    # of a text's rows that of its least doc_id alone, so that copies do not meet
    chosen = texts.select("t", "doc_id").join(ends, "t", "left_semi")
    held = docs.select(text_of().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"))
    held = held.withColumn("t", F.unhex(F.md5("text"))).join(chosen, ["t", "doc_id"], "left_semi")
    held = held.select("t", words(ascii_lower(F.col("text"))).alias("w")).select("t", F.array_distinct(window_hashes(F.col("w"), width)).alias("h"))
    sets = saved(held.groupBy("t").agg(F.first("h").alias("h")), f"{path}/sets")
    joined = pairs.join(sets.withColumnsRenamed({"t": "a", "h": "x"}), "a").join(sets.withColumnsRenamed({"t": "b", "h": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    joined = joined.select("a", "b", shared.alias("n"), (F.size("x") + F.size("y")).alias("both"))
    linked = joined.where((F.col("both") == 0) | (F.col("n") >= similarity * (F.col("both") - F.col("n")))).select("a", "b")

    def run(group: pa.Table) -> pa.Table:
        names, lists = group.column("t").to_pylist(), group.column("h")
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        values = pc.list_flatten(lists).to_numpy()
        found = linked_pairs(values, starts, similarity)
        return pa.table({"a": pa.array([names[x] for x, _ in found], pa.binary()), "b": pa.array([names[y] for _, y in found], pa.binary())})

    return linked.union(crowds.join(sets, "t").select("g", "t", "h").groupBy("g").applyInArrow(run, "a binary, b binary"))


def keep_one(docs: DataFrame, path: str, width: int = 5, radius: int = 4, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay."""
    rows = saved(marks(docs, width), f"{path}/marks")
    texts = saved(rows.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("sig").alias("sig")), f"{path}/texts")
    # equal fingerprints meet in a star around one of their texts, close ones through those
    heads = texts.groupBy("fp").agg(F.min("t").alias("head"))
    same = texts.join(heads, "fp").where("t <> head").select(F.least("t", "head").alias("a"), F.greatest("t", "head").alias("b"))
    near = links(heads.select(F.col("fp").alias("fingerprint")), radius)
    near = near.join(heads.withColumnsRenamed({"fp": "a", "head": "ta"}), "a").join(heads.withColumnsRenamed({"fp": "b", "head": "tb"}), "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    looks = saved(candidates(texts, similarity), f"{path}/candidates")
    crowds = looks.where("g IS NOT NULL").select("g", F.col("a").alias("t"))
    pairs = saved(looks.where("g IS NULL").select("a", "b").union(same).union(near).distinct(), f"{path}/pairs")
    linked = saved(similar(docs, texts, pairs, crowds, width, similarity, path), f"{path}/similar")
    labels = components(linked, f"{path}/components").withColumnRenamed("node", "t")
    grouped = texts.select("t", "doc_id").join(labels, "t", "left").withColumn("label", F.coalesce("label", "t"))
    stay = saved(grouped.groupBy("label").agg(F.min(F.struct("doc_id", "t")).alias("stay")).select("stay.*"), f"{path}/stay")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(text_of())).alias("t"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"))
    return keyed.join(stay, ["t", "doc_id"]).groupBy("t", "doc_id").agg(F.first("row").alias("row")).select("row.*")
