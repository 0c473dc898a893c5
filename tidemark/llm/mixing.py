"""Mixing of sources to target weights by pivotal dependent rounding.

Each source gets a target of words; a document then carries target / size copies,
in all but a whole and a fractional part. Fractional parts are rounded together:
two open documents pass words from one to the other, at random but fair, until
one of them has no part or a whole copy. Words are what is passed, so a source's
sum never changes, and each block of a source ends with one open document at
most. The open ones of many blocks meet in the next level of a reduction tree,
until one is left in each source. That one is cut to the words still due
(``last="cut"``) or rounded to none or a whole copy (``last="round"``).

Null text has size 0 and takes nothing. A source without words has target 0. Null
sources come last. Repeated rows are documents of their own. Order, ties and every
random draw come from hashes of ids and sizes, so reruns agree. An empty table gives
no rows. mix() reads doc_id, text and source alone, mixed_documents() returns all columns,
whatever their names; rows are one another's copies if they are equal in all of them, and
such rows share a block. A very long text counts as one document, whatever its share.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, text_of, work_dir

WEIGHTS = (3, 1, 2)
#: Open documents that one task of the tree brings down to one.
BLOCK = 4096
SLIM = "ra long, rb long, source string, doc_id long, size long, source_size long, target double, whole long, part double, tie long, block long, open boolean"


def row_key(docs: DataFrame) -> list[Column]:
    """128 bits of a row's values in all columns, as two longs: equal rows, which share them, take their copies together."""
    values = [F.col(f"`{c}`") if "map<" not in kind else F.col(f"`{c}`").cast("string") for c, kind in docs.dtypes]
    return [F.xxhash64(*values).alias("ra"), F.xxhash64(F.lit("row"), *values).alias("rb")]


def with_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, n) with ``target``: share of all words by weight, none above most times its source, the excess reshared by weight.

    The end of that resharing is a common level: target = least(cap, level * weight). Sources whose cap lies lowest for
    their weight are filled first, so the level follows from running sums over the sources by cap / weight. The one
    window without a key runs over one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumns({
        "full": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        "all": share * F.sum("source_size").over(everything),
    })
    level = (F.col("all") - F.col("full")) / F.col("rest")
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") < F.col("cap"), level))
    ranked = ranked.withColumn("level", F.max("level").over(everything))
    # the first source below its cap has the level, and later ones see less; where all are at their caps there is none
    return ranked.select("source", "source_size", "n", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _fair(tie: int, other: int) -> float:
    """A number in [0, 1) from two hashes."""
    x = (tie * 0x9E3779B97F4A7C15 + other * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return (x >> 11) / 2**53


def pivot(sizes: list[int], parts: list[float], ties: list[int]) -> tuple[list[float], int | None]:
    """Parts after pairwise passing of words: each is 0 or 1 but one at most, whose place is given; their sum in words stays."""
    parts, held = list(parts), None
    for k, part in enumerate(parts):
        if not 0.0 < part < 1.0:
            continue
        if held is None:
            held = k
            continue
        a, b = held, k
        up = min((1 - parts[a]) * sizes[a], parts[b] * sizes[b])  # words that can go from b to a
        down = min(parts[a] * sizes[a], (1 - parts[b]) * sizes[b])
        words = up if _fair(ties[a], ties[b]) * (up + down) < down else -down
        new = [parts[a] + words / sizes[a], parts[b] - words / sizes[b]]
        for place, value in zip((a, b), new, strict=True):
            parts[place] = 0.0 if value < 1e-9 else 1.0 if value > 1 - 1e-9 else value
        still = [place for place in (a, b) if 0.0 < parts[place] < 1.0]
        held = still[0] if still else None
    return parts, held


def _reduce(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["tie", "ra", "rb"], kind="stable", na_position="first").reset_index(drop=True)
    parts, held = pivot(block["size"].tolist(), block["part"].tolist(), block["tie"].tolist())
    block["part"] = parts
    block["open"] = block.index == (-1 if held is None else held)
    return block


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, last: str = "cut") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and the row's key (ra, rb) of every row of docs."""
    path = work_dir(docs.sparkSession)
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")
    slim = docs.select(*row_key(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size)
    slim = saved(slim, f"{path}/sizes")
    targets = with_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most)
    targets = saved(targets, f"{path}/targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a target's rate may come out a hair above a whole number
    whole = F.least(F.floor(rate + 1e-12), F.lit(int(most))).cast("long")
    hashed = F.xxhash64(F.lit(seed), "ra", "rb")
    rows = slim.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    taken_whole = F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("long")
    taken_part = F.when((F.col("size") > 0) & (rate - whole > 1e-12), rate - whole).otherwise(0.0)
    rows = rows.withColumns({"whole": taken_whole, "part": taken_part, "tie": hashed})
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    rows = rows.withColumns({"block": F.pmod(F.xxhash64(F.lit("block"), "tie"), blocks), "open": F.col("part") > 0})
    rows = rows.select("ra", "rb", "source", "doc_id", "size", "source_size", "target", "whole", "part", "tie", "block", "open")
    done = [rows.where("NOT open")]
    most_blocks = (targets.agg(F.max("n")).first()[0] or 0) / BLOCK
    opened, level = rows.where("open"), 0
    while True:
        level += 1
        reduced = saved(opened.groupBy("source", "block").applyInPandas(_reduce, SLIM), f"{path}/level={level}")
        done.append(reduced.where("NOT open"))
        opened = reduced.where("open").withColumn("block", F.floor(F.col("block") / BLOCK))
        if most_blocks <= 1:
            break
        most_blocks /= BLOCK
    if last == "round":
        drawn = F.pmod(F.xxhash64(F.lit("last"), F.lit(seed), "tie"), F.lit(1 << 20)) < F.col("part") * (1 << 20)
        opened = opened.withColumns({"part": F.when(drawn, 1.0).otherwise(0.0), "open": F.lit(False)})
    out = opened
    for part in done:
        out = out.unionByName(part)
    copies = F.col("whole") + F.when(F.col("open"), F.col("part")).otherwise(F.round("part"))
    taken = F.round(copies * F.col("size")).cast("long").alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", taken, copies.alias("copies"), "ra", "rb")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: whole documents only."""
    plan = mix(docs, **{**options, "last": "round"}).groupBy("ra", "rb").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(*row_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.groupBy("ra", "rb").agg(F.first("row").alias("row"))  # rows that are equal in all columns
    return rows.join(plan, ["ra", "rb"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
