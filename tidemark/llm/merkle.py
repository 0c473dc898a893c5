"""Merkle manifest of a dataset by nested-struct rollup: leaves, subroots, root, and a proof for every row.

Rows get their ranks within their group by a range sort. A node's rank is written in
digits of base ``fanout``; nodes whose ranks differ in the last DIGITS digits only are one
block, of fanout^DIGITS nodes at most. Within a block the digit columns are grouped away
one after the other, the last first: each grouping makes its children, structs, an array
of their parent's struct, and the parent's hash from theirs. The block is shuffled once;
the groupings after that keep its partitioning. What is left is a nested struct a block,
and the blocks' own hashes are the nodes of the next, fanout^DIGITS times smaller rollup,
until one node is left. On the way down a block's struct and the path above it meet in one
grouping; a transform through the nested arrays carries the path to each child and adds its
siblings, and an explode emits the children with their paths. No join makes a proof.

A path is an array of (l, r), from the node upwards: hexadecimal digests of its siblings on
the left and on the right, concatenated. A node without siblings is hashed alone as long as
its level has other nodes. Groups' roots (subroots) in their order, null first, are the
leaves of one more tree of the same kind, whose root is that of the dataset.

Edge cases: null fields are hashed as ``-``, empty ones as ``0:``. Rows of one order value
are ordered by their leaf; equal rows are leaves of their own. A null order value comes
first. One row alone has itself as subroot and root and an empty path. A very long text is
hashed where it is read; only digests travel. An empty table gives no rows. Input columns
are returned in ``row`` as far as ``keep`` names them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

DIGITS = 6
PATH = "array<struct<l: string, r: string>>"


def field(value: Column) -> Column:
    """The value's part of a leaf: ``-`` if it is null, else its UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def ranked(nodes: DataFrame, group: list[str], order: list[str], path: str) -> DataFrame:
    """nodes with ``rank`` (from 0) and ``n``, the number of nodes, within their group. No group passes one task: rows are sorted by ranges and numbered within each, ranges are counted."""
    spread = nodes.withColumn("__tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*group, *order, "__tie").sortWithinPartitions(*group, *order, "__tie").drop("__tie")
    held = saved(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), f"{path}/sorted")
    runs = held.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    own = W.partitionBy(*group)  # a row for each range that a group has rows in
    before = F.sum("__rows").over(own.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(*group, "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(own).alias("n"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in group]
    joined = held.alias("x").join(runs.alias("y"), [F.col("x.__part") == F.col("y.__part"), *same])
    rank = (F.col("x.__at") - F.col("y.__first") + F.col("y.__before")).alias("rank")
    return joined.select(*[F.col(f"x.{c}") for c in nodes.columns], rank, F.col("y.n"))


def _levels(n: Column, fanout: int, level: int) -> Column:
    """Whether a group of n leaves has a level above this one."""
    return n > F.lit(fanout**level)


def rolled(nodes: DataFrame, fanout: int, path: str, below: int = 0) -> DataFrame:
    """A nested struct ``node`` (hash, kids) for each block (g, rank, n) of nodes (g, rank, n, hash, keep), which stand below levels above the leaves."""
    names = [f"d{i}" for i in range(DIGITS)]
    digits = [F.pmod(F.floor(F.col("rank") / F.lit(fanout**i)), F.lit(fanout)).cast("int").alias(c) for i, c in enumerate(names)]
    block = F.floor(F.col("rank") / F.lit(fanout**DIGITS)).alias("block")
    held = nodes.select("g", block, "n", *digits, F.struct("hash", "keep").alias("node")).repartition("g", "block")
    for i, name in enumerate(names):
        kids = F.transform(F.sort_array(F.collect_list(F.struct(name, "node"))), lambda x: x["node"])
        held = held.groupBy("g", "block", "n", *names[i + 1 :]).agg(kids.alias("kids"))
        hashes = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        parent = F.when(_levels(F.col("n"), fanout, below + i), F.sha2(hashes, 256)).otherwise(F.col("kids")[0]["hash"])
        held = held.select("g", "block", "n", *names[i + 1 :], F.struct(parent.alias("hash"), "kids").alias("node"))
    return saved(held.select("g", F.col("block").alias("rank"), "n", "node"), path)


def _below(node: Column, above: Column, n: Column, fanout: int, below: int, depth: int) -> Column:
    """An array of (keep, path) of the nodes that depth levels of a nested struct lead to; above is the struct's own path."""
    kids = node["kids"]
    hashes = F.transform(kids, lambda x: x["hash"])

    def path(i: Column) -> Column:
        left = F.array_join(F.slice(hashes, F.lit(1), i), "")
        right = F.array_join(F.slice(hashes, i + 2, F.size(kids)), "")
        own = F.when(_levels(n, fanout, below + depth - 1), F.array(F.struct(left.alias("l"), right.alias("r")))).otherwise(F.array().cast(PATH))
        return F.concat(own, above)

    if depth == 1:
        return F.transform(kids, lambda x, i: F.struct(x["keep"].alias("keep"), path(i).alias("path")))
    return F.flatten(F.transform(kids, lambda x, i: _below(x, path(i), n, fanout, below, depth - 1)))


def rollup(nodes: DataFrame, fanout: int, path: str) -> list[DataFrame]:
    """The blocks of nodes (g, rank, n, hash, keep), the blocks of those, and so on until each group is one node, of rank 0."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    while not levels or fanout ** (len(levels) * DIGITS) < most:
        levels.append(rolled(nodes, fanout, f"{path}/level={len(levels)}", len(levels) * DIGITS))
        nodes = levels[-1].select("g", "rank", "n", F.col("node.hash").alias("hash"), F.struct("rank").alias("keep"))
    return levels


def descended(levels: list[DataFrame], facts: DataFrame, fanout: int) -> DataFrame:
    """keep, path, top (the hash that its group comes to) and root of each node that went into rollup(). facts: path and root of each group g."""
    facts = facts.select("g", F.lit(0).cast("long").alias("rank"), "path", "root", F.lit(None).cast("string").alias("top"))
    for k in reversed(range(len(levels))):
        level = levels[k]
        # a block and what is known of it meet in one grouping of two rows
        own = level.select("g", "rank", "n", "node", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("top"))
        known = facts.select("g", "rank", F.lit(None).cast("long").alias("n"), F.lit(None).cast(level.schema["node"].dataType).alias("node"), "path", "root", "top")
        met = own.union(known).groupBy("g", "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", "root", "top")])
        met = met.withColumn("top", F.coalesce("top", "node.hash"))
        each = met.select("g", "root", "top", F.explode(_below(F.col("node"), F.col("path"), F.col("n"), fanout, k * DIGITS, DIGITS)).alias("x"))
        facts = each.select("g", F.col("x.keep").alias("keep"), F.col("x.path").alias("path"), "root", "top")
        if k:
            facts = facts.select("g", F.col("keep.rank").alias("rank"), "path", "root", "top")
    return facts


def manifest(docs: DataFrame, path: str, fields: list[str], group: str, order: str, keep: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """The columns of keep, leaf, subroot, root and path (array of (l, r), up to the root) of each row of docs.

    fields: what a leaf is a digest of, in order; group and order: names of columns. path: a new folder that all executors share.
    """
    kept = {"__leaf": digest(*[field(F.col(f"`{c}`")) for c in fields])} | (keep or {})
    leaves = docs.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{order}`").alias("__order"), F.struct(*[v.alias(c) for c, v in kept.items()]).alias("keep"))
    leaves = saved(leaves.withColumn("hash", F.col("keep.__leaf")), f"{path}/leaves")
    leaves = saved(ranked(leaves, ["g"], ["__order", "hash"], f"{path}/ranks").drop("__order"), f"{path}/ranked")
    levels = rollup(leaves, fanout, f"{path}/rows")
    groups = levels[-1].select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("node.hash").alias("hash"), F.struct("g").alias("keep"))
    groups = ranked(groups, ["g"], ["name"], f"{path}/groups/ranks")
    above = rollup(groups.drop("name"), fanout, f"{path}/groups")
    start = docs.sparkSession.range(1).select(F.lit(0).alias("g"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("root"))
    known = descended(above, start, fanout)
    known = known.select(F.col("keep.g").alias("g"), "path", F.col("top").alias("root"))
    found = descended(levels, known, fanout)
    return found.select(*[F.col("keep")[c].alias(c) for c in keep or {}], F.col("keep.__leaf").alias("leaf"), F.col("top").alias("subroot"), "root", "path")


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings of a path, from the leaf to the root, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf comes to with the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["l"], h, x["r"]))
