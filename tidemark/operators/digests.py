"""Digests of tables that need neither order nor file bytes: sums over rows of two parts of each row's MD5.

Two tables of equal rows, each as often, have equal digests in whatever order and files they
are; partial sums add up, so it is one map-side aggregate for all runs at once. Sums are exact
decimals of 38 digits, enough for 10^19 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(columns: list[Column]) -> Column:
    """All values of a row as one text that no other row has: byte counts before the values, ``-`` for null."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[one(c) for c in columns])


def _part(md5: Column, start: int) -> Column:
    return F.conv(F.substring(md5, start, 15), 16, 10).cast("decimal(20,0)")


def digests(table: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(keys, n_rows, a, b) of a table: rows and digest of each key, by default each run_id. columns: those that count, by default all but the keys; nested ones count as their JSON."""
    keys = ["run_id"] if keys is None else keys
    names = columns or [c for c in table.columns if c not in keys]
    kinds = dict(table.dtypes)
    values = [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if kinds[c].startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c in names]
    held = table.select(*keys, F.md5(row_text(values)).alias("__m"))
    return held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(_part(F.col("__m"), 1)).alias("a"), F.sum(_part(F.col("__m"), 16)).alias("b"))


def sources(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, source, n_rows, a, b) of several tables by run."""
    held = None
    for name, table in tables.items():
        one = digests(table).select("run_id", F.lit(name).alias("source"), "n_rows", "a", "b")
        held = one if held is None else held.union(one)
    return held


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(run_id, source) of what differs between two readings of sources(), or is in one alone."""
    keys = ["run_id", "source"]
    both = before.select(*keys, F.struct("n_rows", "a", "b").alias("was")).join(now.select(*keys, F.struct("n_rows", "a", "b").alias("is")), keys, "full")
    return both.where(~F.col("was").eqNullSafe(F.col("is"))).select(*keys)
