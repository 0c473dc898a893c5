"""N-gram Jaccard join: every link between documents whose sets of word windows are similar enough, by prefix trees.

A document's set is that of its distinct windows of ``width`` words, A-Z lower-cased, known by
64-bit hashes; fewer words make one window. Sets x and y are linked when 100 * |x & y| >= percent
* |x | y|. What is returned is enough to name each document's component, never all pairs.

1. Equal sets are one set. A set of n windows shares all but floor(n * (100 - percent) / 100) of
   them with any partner (p is one more than that). In ascending order of hashes, the k smallest
   common windows of two sets are among the first p + k - 1 of each. With k = 1 + p // 2, a set
   whose first windows include too few that any other set's first windows have can't be linked
   with any, and goes. No window leaves a task but these, about 3 in 10.
2. Of what is left, windows are counted over whole sets; a set with too few windows that occur
   twice goes. The others are put into global order, the rarest first, those of their own alone
   left out but counted. Two linked sets share a window of their first p in that order.
3. Sets that share such a window, directly or over others, are one crowd. Of a crowd of at most
   CROWD windows in all, all sets meet in one group. In larger ones those that share a window
   meet, and if these are too many, each two blocks of them.
4. A group stores its sets in a prefix tree, in the global order turned round, the most frequent
   window first, so that copies share their path. Edges are compressed: a node is a run of
   windows. A set walks down from the root with the overlap so far, which all sets below a node
   share; a subtree is left out where that and the windows that can still follow, on its own
   side or in the longest set below, do not reach what its smallest set would need, or where all
   sets below are already of the walker's component. The links found are a spanning forest.

Edge cases: null, empty and blank texts have no set, are linked with nothing, and are their own
component. Rows of equal text, equal rows and rows of one doc_id each have a row. A component's id
is its smallest doc_id that is not null. A very long text is hashed whole, its set being one array
of longs. An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_to_facts, saved, text_of
from .components import components
from .word_windows import parts, shingle_sets

#: Windows of the sets that meet in one group, one pair of sets at least.
CROWD = 2_000_000
#: Sets whose texts' keys (40 bytes each) are sent to the texts, at most.
SENT = 200_000
#: Windows that a task looks through for such as it has twice.
LOCAL = 8_000_000


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Windows that a set of n shares with any partner."""
    return (n * percent + 99) // 100


def _first(n: int | np.ndarray, percent: int) -> tuple[int | np.ndarray, int | np.ndarray]:
    """How many of the smallest windows of a set of n are looked at, and how many of them are others', of a partner of n or more."""
    p = n - needed(n, percent) + 1
    k = 1 + p // 2
    return p + k - 1, k


def marks(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, t (the text's MD5), n (windows in its set), key (the set's MD5; null without words) and head (its smallest windows) of each row."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text_of())).alias("t"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in parts(batch.column(2)):
                values, starts = shingle_sets(data, offsets, width)
                sizes, n = np.diff(starts), len(offsets) - 1
                keys = [md5(values[a:b].tobytes()).digest() if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
                heads = np.where(sizes > 0, _first(sizes, percent)[0], 0)
                inside = np.arange(len(values)) - np.repeat(starts[:-1], sizes) < np.repeat(heads, sizes)
                ends = pa.array(np.concatenate(([0], np.cumsum(heads))), pa.int32())
                head = pa.ListArray.from_arrays(ends, pa.array(values[inside].view(np.int64)))
                own = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), head], ["doc_id", "t", "n", "key", "head"])

    return held.mapInArrow(run, "doc_id long, t binary, n long, key binary, head array<long>")


def whole_sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """s, n and h (all windows) of each of chosen (s, doc_id, t), from the texts."""
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.unhex(F.md5(text_of())).alias("t"), text_of().alias("text"))
    chosen = chosen.select("s", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "t")
    # few enough go to the texts; else the texts are shuffled
    chosen = F.broadcast(chosen) if chosen.count() <= SENT else chosen
    held = held.join(chosen, ["doc_id", "t"]).select("s", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in parts(batch.column(1)):
                values, starts = shingle_sets(data, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offsets) - 1), pa.array(np.diff(starts), pa.int64()), lists], ["s", "n", "h"])

    # equal rows give a set more than once
    return held.mapInArrow(run, "s long, n long, h array<long>").groupBy("s").agg(F.first("n").alias("n"), F.first("h").alias("h"))


def _ceiled(n: str, percent: int) -> str:
    return f"({n} * {percent} + 99) div 100"


def possible(sets: DataFrame, percent: int) -> DataFrame:
    """The rows of sets (s, n, head) that may have a partner."""

    def combined(names: np.ndarray, heads: list[pa.Array]) -> pa.RecordBatch:
        """(h, s, c): windows of one set here (c 1), windows of several, without a set (c 2), and how many of the latter each set has (-c)."""
        sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in heads])
        values = np.concatenate([x.flatten().to_numpy() for x in heads])
        owner = np.repeat(np.arange(len(names)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.append(True, values[1:] != values[:-1])[: len(values)]
        single = new & np.append(new[1:], True)[: len(values)]
        again = np.bincount(owner[~single], minlength=len(names))
        has = again > 0
        h = np.concatenate([values[single], values[new & ~single], names[has]])
        s = np.concatenate([names[owner[single]], np.full(int((new & ~single).sum()), -1), names[has]])
        c = np.concatenate([np.ones(int(single.sum()), np.int32), np.full(int((new & ~single).sum()), 2, np.int32), -again[has].astype(np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), pa.array(c)], ["h", "s", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, heads, size = [], [], 0
        for batch in batches:
            names.append(batch.column(0).to_numpy())
            heads.append(batch.column(1))
            size += len(heads[-1].flatten())
            if size > LOCAL:
                yield combined(np.concatenate(names), heads)
                names, heads, size = [], [], 0
        if names:
            yield combined(np.concatenate(names), heads)

    # a window that many sets have comes once from each task, so that none meets more than a row a task
    rows = sets.select("s", "head").mapInArrow(run, "h long, s long, c int")
    seen = F.sum(F.greatest("c", F.lit(0))).over(W.partitionBy("h"))
    rows = rows.withColumn("seen", seen).where("c < 0 OR (seen > 1 AND s >= 0)")
    shared = rows.groupBy("s").agg(F.sum(F.greatest(-F.col("c"), F.lit(1))).alias("shared"))
    least = _ceiled("n", percent)  # the fewest windows of a partner
    return sets.drop("head").join(shared, "s").where(f"shared >= 1 + ({least} - {_ceiled(f'({least})', percent)} + 1) div 2").drop("shared")


def in_order(sets: DataFrame, percent: int) -> DataFrame:
    """s, n and h, the windows that other sets have too in global order, the rarest first. Sets (s, n, h) without enough of them are left out."""
    each = sets.select("s", "n", F.explode("h").alias("h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    held = each.join(counts, "h").groupBy("s", "n").agg(F.collect_list(F.struct("c", "h")).alias("h"))
    return held.where(f"size(h) >= {_ceiled('n', percent)}").select("s", "n", F.transform(F.sort_array("h"), lambda x: x["h"]).alias("h"))


def groups(ordered: DataFrame, percent: int, path: str) -> DataFrame:
    """(g, s): the sets that meet in each group; two sets that share a window of their first ones meet at least once."""
    size = F.size("h").cast("long")
    # of the first n - needed + 1 windows those of the set alone come first and are not in h
    own = ordered.select("s", "n", "h", size.alias("m"), F.expr(f"size(h) - {_ceiled('n', percent)} + 1").cast("int").alias("p"))
    firsts = saved(own.select("s", "m", F.explode(F.slice("h", F.lit(1), F.col("p"))).alias("h")), f"{path}/firsts")
    heads = firsts.groupBy("h").agg(F.min("s").alias("head"), F.count(F.lit(1)).alias("c"), F.sum("m").alias("windows")).where("c > 1")
    heads = saved(heads, f"{path}/heads")
    edges = firsts.join(heads.select("h", "head"), "h").where("s <> head").select(F.col("s").alias("a"), F.col("head").alias("b"))
    labels = components(edges, f"{path}/crowds").withColumnsRenamed({"node": "s", "label": "g"})
    members = saved(labels.join(own.select("s", "m"), "s"), f"{path}/members")
    total = members.groupBy("g").agg(F.sum("m").alias("windows"))
    small = members.join(total.where(F.col("windows") <= CROWD).select("g"), "g", "left_semi").select("g", "s")
    large = members.join(total.where(F.col("windows") > CROWD).select("g"), "g", "left_semi").select("s")
    # the sets of a large crowd meet window by window, each two blocks of them where those of a window are too many
    blocks = F.ceil(2 * F.col("windows") / CROWD).cast("int")
    met = firsts.join(large, "s", "left_semi").join(heads.select("h", "windows"), "h").withColumn("blocks", F.when(F.col("windows") > CROWD, blocks).otherwise(1))
    block = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    met = met.withColumn("block", block).select("s", "h", F.explode(pairs).alias("x"))
    return small.union(met.select(F.xxhash64("h", "x.i", "x.j").alias("g"), "s"))


class Tree:
    """A compressed prefix tree of sets: rows of values, each set's ascending, from each start to the next; n is what the sets' sizes count as."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, n: np.ndarray):
        self.values, lengths = values, np.diff(starts)
        keys = [values[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        #: Sets in the tree's order; the sets below a node are neighbours in it.
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        # nodes: where its run of values is, the places [low, high) of its sets, how deep its run begins
        run, low, high, depth, kids = [(0, 0)], [0], [len(keys)], [0], [[]]
        open_ = [0]  # the way to the last set
        ends, last = [0], []  # how deep each node of it ends; the node that each set ends at
        before: np.ndarray | None = None
        for place, s in enumerate(self.order):
            own = values[starts[s] : starts[s + 1]]
            shared = 0
            if before is not None:
                m = min(len(before), len(own))
                differ = np.flatnonzero(before[:m] != own[:m])
                shared = int(differ[0]) if len(differ) else m
            while len(open_) > 1 and ends[-2] >= shared:
                high[open_.pop()] = place
                ends.pop()
            if ends[-1] > shared:  # the last node is cut in two: its upper part gets the rest as its first kid
                x = open_[-1]
                cut = run[x][0] + shared - depth[x]
                lower = len(run)
                run.append((cut, run[x][1])), low.append(low[x]), high.append(place), depth.append(shared), kids.append(kids[x])
                run[x], kids[x], ends[-1] = (run[x][0], cut), [lower], shared
                i = low[x]
                while i < place and last[i] == x:
                    last[i], i = lower, i + 1
            if len(own) > shared or before is None:
                node = len(run)
                run.append((int(starts[s]) + shared, int(starts[s + 1]))), low.append(place), high.append(len(keys)), depth.append(shared), kids.append([])
                kids[open_[-1]].append(node)
                open_.append(node)
                ends.append(len(own))
            last.append(open_[-1])
            before = own
        for x in open_:
            high[x] = len(keys)
        self.first, self.last = np.array(run, np.int64).T
        self.low, self.high, self.depth = (np.array(x, np.int64) for x in (low, high, depth))
        self.kid_starts = np.concatenate(([0], np.cumsum([len(x) for x in kids])))
        self.kids = np.array([k for x in kids for k in x], np.int64)
        self.end = self.depth + self.last - self.first
        self.sizes, longest = n[self.order], lengths[self.order]
        #: Sets that end at a node; they come first of those below it.
        self.stops = np.bincount(np.array(last, np.int64), minlength=len(run))
        # a node's sets are neighbours, so that the least and the longest of them are those of ranges
        span = np.stack([self.low, np.maximum(self.high, self.low + 1)], 1).ravel()
        self.least = np.minimum.reduceat(np.append(self.sizes, 2**62), span)[::2]
        self.longest = np.maximum.reduceat(np.append(longest, 0), span)[::2]
        self.held = np.zeros(int(values.max(initial=0)) + 1, np.int32)

    def linked(self, own: np.ndarray, n: int, percent: int, alive: np.ndarray) -> np.ndarray:
        """Places in the tree's order of the alive sets that a set of these values, which counts as n, is linked with."""
        left = np.concatenate(([0], np.cumsum(alive)))
        self.held[own] = 1
        found = []
        nodes, overlap = np.array([0]), np.array([0])
        while len(nodes):
            stops = self.stops[nodes]
            if stops.any():
                places = _ranges(self.low[nodes], stops)
                enough = (100 + percent) * np.repeat(overlap, stops) >= percent * (n + self.sizes[places])
                found.append(places[enough & alive[places]])
            counts = self.kid_starts[nodes + 1] - self.kid_starts[nodes]
            kids = self.kids[_ranges(self.kid_starts[nodes], counts)]
            overlap = np.repeat(overlap, counts)
            keep = left[self.high[kids]] > left[self.low[kids]]
            kids, overlap = kids[keep], overlap[keep]
            if not len(kids):
                break
            spans = self.last[kids] - self.first[kids]
            held = self.held[self.values[_ranges(self.first[kids], spans)]]
            overlap = overlap + np.add.reduceat(np.append(held, 0), np.concatenate(([0], np.cumsum(spans)[:-1])))
            rest = len(own) - np.searchsorted(own, self.values[self.last[kids] - 1], "right")
            most = overlap + np.minimum(rest, self.longest[kids] - self.end[kids])
            keep = (100 + percent) * most >= percent * (n + self.least[kids])
            nodes, overlap = kids[keep], overlap[keep]
        self.held[own] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its count."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)


def forest(values: np.ndarray, starts: np.ndarray, n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of linked sets that join every component of all such pairs. values: each set's windows, from each start to the next."""
    _, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    ids, owner = rank[ids], np.repeat(np.arange(len(n)), np.diff(starts))
    ids = ids[np.lexsort((ids, owner))]
    tree = Tree(ids, starts, n)
    alive, pairs = np.ones(len(n), bool), []
    for seed in range(len(n)):
        if not alive[seed]:
            continue
        alive[seed] = False
        open_ = [seed]
        while open_ and alive.any():
            x = open_.pop()
            s = tree.order[x]
            near = tree.linked(ids[starts[s] : starts[s + 1]], int(n[s]), percent, alive)
            alive[near] = False
            open_ += near.tolist()
            pairs += [(int(s), int(tree.order[y])) for y in near]
    return pairs


def links(ordered: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets: enough links to join every component. members: (g, s)."""

    def run(group: pa.Table) -> pa.Table:
        names, lists = group.column("s").to_pylist(), group.column("h")
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        found = forest(pc.list_flatten(lists).to_numpy(), starts, group.column("n").to_numpy(), percent) if len(names) > 1 else []
        return pa.table({"a": pa.array([names[x] for x, _ in found], pa.int64()), "b": pa.array([names[y] for _, y in found], pa.int64())})

    return members.join(ordered, "s").select("g", "s", "n", "h").groupBy("g").applyInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, path: str, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs. path: a new folder that all executors share."""
    rows = saved(marks(docs, width, percent), f"{path}/marks")
    with_words = rows.where("key IS NOT NULL")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t")).alias("one")
    sets = with_words.groupBy("key").agg(one, F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("head").alias("head"))
    sets = saved(sets.select(F.monotonically_increasing_id().alias("s"), "key", "one.doc_id", "one.t", "n", "copies", "head"), f"{path}/sets")
    left = saved(possible(sets.drop("key", "copies"), percent), f"{path}/left")
    whole = saved(whole_sets(docs, left, width), f"{path}/whole")
    ordered = saved(in_order(whole, percent), f"{path}/ordered")
    linked = saved(links(ordered, groups(ordered, percent, path), percent), f"{path}/links")
    labels = components(linked, f"{path}/components").withColumnRenamed("node", "s")
    named = sets.select("s", "key", "doc_id", "copies").join(labels, "s", "left").withColumn("label", F.coalesce("label", "s"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = saved(named.join(least, "label").select("key", "component_id", "copies"), f"{path}/classes")
    joined = joined_to_facts(with_words.select("doc_id", "n", "key"), classes, ["key"], with_words.count())
    alone = rows.where("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)
