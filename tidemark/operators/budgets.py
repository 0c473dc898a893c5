"""Greedy chunks of timed items, and text budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chains


def chunks(rows: DataFrame, keys: list[str], longest: float, most: int | None = None) -> DataFrame:
    """(keys, chunk, s, e, n) of rows (keys, s, e, seg_id), by start within each key; see :func:`chains.chunked`."""
    each = chains.chunked(rows, keys, longest, most)
    return each.groupBy(*keys, "chunk").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))


#: Items of an open part of a list that a fold grows.
PART = 512


def grown(kind: str) -> Column:
    """An empty list of a fold's results, of this type, that grows in parts: adding an item copies the open part alone, so a fold over n items takes n * PART copies at most, not n * n."""
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("open"))


def added(held: Column, item: Column) -> Column:
    """A grown list with one more item."""
    whole = F.struct(F.concat(held["full"], F.array(held["open"])).alias("full"), F.array(item).alias("open"))
    return F.when(F.size(held["open"]) >= PART, whole).otherwise(F.struct(held["full"].alias("full"), F.concat(held["open"], F.array(item)).alias("open")))


def listed(held: Column) -> Column:
    """A grown list as an array."""
    return F.flatten(F.concat(held["full"], F.array(held["open"])))


def within_budget(texts: Column, each: int, whole: int) -> Column:
    """Texts clipped to ``each`` characters until ``whole`` is used up; the last is clipped to what is left."""
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(held: Column, text: Column) -> Column:
        fitted = T.clip(T.clip(text, each), F.lit(whole) - held["used"])
        return F.when(held["used"] >= whole, held).otherwise(F.struct((held["used"] + F.char_length(fitted)).alias("used"), F.concat(held["out"], F.array(fitted)).alias("out")))

    return F.aggregate(texts, state, step, lambda held: held["out"])
