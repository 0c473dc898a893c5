"""Greedy chunks of timed items by pointer doubling: where a chunk ends depends on where it began, yet no run passes one task.

1. Items get their positions: rows are dealt by run and by stretches of time between quantiles
   of all starts, numbered there, and what comes before a stretch is added (:func:`running`).
2. Every item gets the item that would begin the next chunk if it began one. An item longer
   than a chunk may be always begins one, so a run falls into parts between such items; within
   a part the latest end so far only grows, and the successor's position is the number of
   items whose latest end is within reach: a running count over items and reaches in one order.
3. Items are grouped in blocks of BLOCK positions. Pointers are followed by doubling: in each
   block to its last chunk, which names the item of a later block that the chain enters by;
   then over these entries, BLOCK times fewer, until no run's chain grows; then, from each
   block's entry, to all chunk starts in the block. A chunk's number is a count of starts.

A run of one block takes no rounds. Each round is two joins of what entries there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..work import folder, settled

#: Positions of a block; rows of a stretch of time that are aimed at.
BLOCK, STRETCH = 4096, 100_000


def stretches(rows: DataFrame, column: str) -> list:
    """Times that divide rows into stretches of about STRETCH rows, ascending and distinct; none for few rows."""
    n = rows.count()
    parts = min(-(-n // STRETCH), 4096)
    if parts < 2:
        return []
    quantiles = rows.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(quantiles))


def stretch(value: Column, cuts: list) -> Column:
    """The number of the stretch that a value lies in; null lies in the first."""
    if not cuts:
        return F.lit(0)
    held, sizes = F.array(*[F.lit(c) for c in cuts]), [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def halved(at: Column, size: Column) -> Column:
        return F.when((at + size <= len(cuts)) & (F.get(held, at + size - 1) <= value), at + size).otherwise(at)

    return F.aggregate(F.array(*[F.lit(x) for x in sizes]), F.lit(0), halved)


def running(rows: DataFrame, keys: list[str], buckets: list[str], order: list[str], of: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with running sums or maxima (name: (``sum`` or ``max``, column)) up to and with each row, in the order of buckets and then of order, within keys.

    A task holds the rows of one bucket of one key; over buckets only totals go on."""
    kinds = {"sum": F.sum, "max": F.max}
    inside = W.partitionBy(*keys, *buckets).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = rows.select("*", *[kinds[kind](column).over(inside).alias(f"__{name}") for name, (kind, column) in of.items()])
    totals = rows.groupBy(*keys, *buckets).agg(*[kinds[kind](column).alias(name) for name, (kind, column) in of.items()])
    before = W.partitionBy(*keys).orderBy(*buckets).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, *buckets, *[kinds[kind](name).over(before).alias(name) for name, (kind, _) in of.items()])
    both = own.join(totals, [*keys, *buckets])
    added = [(F.coalesce(F.col(f"__{name}"), F.lit(0)) + F.coalesce(name, F.lit(0)) if kind == "sum" else F.greatest(f"__{name}", name)).alias(name) for name, (kind, _) in of.items()]
    return both.select(*rows.columns, *added)


def _inside(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successors of all items of some blocks (array of (pos, succ)), the blocks' starts among them, and each item's successor there, or itself."""
    starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    flat = lists.flatten()
    pos, succ = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "succ"))
    ends = np.repeat(starts[1:], np.diff(starts))
    here = np.arange(len(pos))
    there = here + succ - pos
    return succ, starts, np.where(there < ends, there, here)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _exits(blocks: pa.Array) -> pa.Array:
    succ, starts, jump = _inside(blocks)
    while not (jump == (further := jump[jump])).all():
        jump = further
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(succ[jump]))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _numbers(blocks: pa.Array, entry: pa.Array) -> pa.Array:
    """Chunk starts up to each item of its block, from the block's entry (a place in it, or -1) on."""
    _, starts, jump = _inside(blocks)
    at = entry.to_numpy(zero_copy_only=False)
    marked = np.zeros(len(jump), bool)
    marked[(starts[:-1] + at)[at >= 0]] = True
    moving = True
    while moving:
        marked[jump[marked]] = True
        further = jump[jump]
        moving, jump = not (jump == further).all(), further
    total = np.concatenate(([0], np.cumsum(marked)))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array((total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))).astype(np.int32)))


def followed(edges: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, pos) of all that the chain from position 0 enters by edges (keys, pos, succ), 0 among them."""
    found = settled(edges.select(*keys).distinct().withColumn("pos", F.lit(0).cast("long")), f"{path}/found=0")
    jumps, k = edges, 0
    while True:
        k += 1
        new = settled(found.join(jumps, [*keys, "pos"]).select(*keys, F.col("succ").alias("pos")), f"{path}/new={k}")
        if new.isEmpty():
            return found
        found = settled(found.union(new), f"{path}/found={k}")
        onto = jumps.select(*keys, F.col("pos").alias("succ"), F.col("succ").alias("next"))
        jumps = settled(jumps.join(onto, [*keys, "succ"]).select(*keys, "pos", F.col("next").alias("succ")), f"{path}/jumps={k}")


def successors(rows: DataFrame, keys: list[str], longest: float, most: int | None, order: list[str], path: str) -> DataFrame:
    """rows with ``pos`` in their key and ``succ``, the position of the item that begins the next chunk if this one begins one; past the end there is none."""
    cuts = stretches(rows, "s")
    long = F.coalesce(F.col("e") - F.col("s") > longest, F.lit(False))
    held = rows.withColumn("__b", stretch(F.col("s"), cuts))
    held = running(held, keys, ["__b"], order, {"pos": ("sum", F.lit(1)), "__part": ("sum", long.cast("long"))})
    held = held.withColumn("pos", (F.col("pos") - 1).cast("long"))
    held = running(held, [*keys, "__part"], ["__b"], ["pos"], {"__reach": ("max", F.when(~long, F.col("e")))})
    held = settled(held, f"{path}/placed") if cuts else held
    reach = held.select(*keys, "__part", F.col("__reach").alias("__v"), F.lit(0).alias("__asks"), F.lit(None).cast("long").alias("pos"))
    asked = held.select(*keys, "__part", (F.col("s") + F.lit(longest)).alias("__v"), F.lit(1).alias("__asks"), "pos")
    both = reach.union(asked).withColumn("__b", stretch(F.col("__v"), cuts))
    counted = running(both, keys, ["__part", "__b"], ["__v", "__asks"], {"succ": ("sum", (1 - F.col("__asks")).cast("long"))})
    succ = counted.where("__asks = 1").select(*keys, "pos", (F.least("succ", F.col("pos") + most) if most else F.col("succ")).alias("succ"))
    # written rows are small in Parquet and large as a broadcast
    return held.drop("__b", "__part", "__reach").hint("merge").join(succ, [*keys, "pos"])


def near_successors(rows: DataFrame, keys: list[str], longest: float, most: int, order: list[str]) -> DataFrame:
    """As successors(), for chunks of few items in an order that is not that of their starts: each block of positions looks ``most`` items ahead."""
    cuts = stretches(rows, order[0])
    held = running(rows.withColumn("__b", stretch(F.col(order[0]), cuts)), keys, ["__b"], order, {"pos": ("sum", F.lit(1))}).drop("__b")
    held = held.withColumn("pos", (F.col("pos") - 1).cast("long"))
    block = F.floor(F.col("pos") / BLOCK)
    also = F.when(F.col("pos") % BLOCK < most, F.array(block, block - 1)).otherwise(F.array(block))
    ahead = W.partitionBy(*keys, "__block").orderBy("pos")
    far = F.coalesce(*[F.when(F.lead("e", k).over(ahead) - F.col("s") > longest, k) for k in range(1, most)], F.lit(most)) if most > 1 else F.lit(1)
    held = held.withColumn("__block", F.explode(also)).withColumn("succ", F.col("pos") + far)
    return held.where(F.col("__block") == block).drop("__block")


def chunked(rows: DataFrame, keys: list[str], longest: float, most: int | None = None, order: tuple[str, ...] = ("s", "seg_id", "e")) -> DataFrame:
    """rows (keys, s, e, and others) with ``chunk``, from 1 within keys: an item begins a new chunk where it would end over ``longest`` after its chunk's start, or the chunk has ``most`` items.

    Items are taken in the order of these columns; where it doesn't begin with s, most is needed and should be small.
    Rows with a null s or e are left out. Keys may be null; ties in order are rows that stand for one another. Empty tables give no rows."""
    path = folder(rows.sparkSession)
    rows = rows.where(F.col("s").isNotNull() & F.col("e").isNotNull())
    keyed = rows.select(F.struct(*keys).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], "s", "e")
    names = [f"__o{i}" for i in range(len(order))]
    placed = successors(keyed, ["__key"], longest, most, names, path) if order[0] == "s" else near_successors(keyed, ["__key"], longest, most, names)
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    items = F.array_sort(F.collect_list(F.struct("pos", "succ", F.col("__row").alias("row"))), lambda a, b: (a["pos"] - b["pos"]).cast("int"))
    blocks = settled(placed.groupBy("__key", block).agg(items.alias("items")), f"{path}/blocks")
    links = F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), x["succ"].alias("succ")))
    # only a full block can be left for another one
    full = blocks.where(F.size("items") == BLOCK).select("__key", links.alias("l"))
    if full.isEmpty():
        alone = blocks.select(F.transform("items", lambda x: x["row"]).alias("rows"), _numbers(links, F.lit(0)).alias("k"))
        return alone.select(F.explode(F.arrays_zip("rows", "k")).alias("x")).select("x.rows.*", F.col("x.k").cast("long").alias("chunk"))
    out = full.select("__key", F.explode(F.arrays_zip("l", _exits("l").alias("exit"))).alias("x")).select("__key", F.col("x.l.pos").alias("pos"), F.col("x.exit").alias("succ"))
    out = settled(out, f"{path}/exits")
    # what the chain can enter a block by: its first item, and what another block is left to
    ends = out.select("__key", F.col("succ").alias("pos")).distinct()
    edges = settled(out.join(ends, ["__key", "pos"], "left_semi").union(out.where("pos = 0")).distinct(), f"{path}/edges")
    entries = followed(edges, ["__key"], path).where("pos > 0").select("__key", block, (F.col("pos") % BLOCK).cast("int").alias("entry"))
    entered = blocks.join(entries, ["__key", "block"], "left")
    entry = F.when(F.col("block") == 0, 0).otherwise(F.coalesce("entry", F.lit(-1))).cast("int")
    numbered = settled(entered.select("__key", "block", F.transform("items", lambda x: x["row"]).alias("rows"), _numbers(links, entry).alias("k")), f"{path}/numbered")
    starts = numbered.select("__key", "block", F.element_at("k", -1).alias("n"))
    before = F.sum("n").over(W.partitionBy("__key").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select("__key", "block", F.coalesce(before, F.lit(0)).alias("before"))
    each = numbered.join(starts, ["__key", "block"]).select("before", F.explode(F.arrays_zip("rows", "k")).alias("x"))
    return each.select("x.rows.*", (F.col("before") + F.col("x.k")).alias("chunk"))
