"""Validation as tables of violations: a run fails if it has any, by its first rule and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(rows: DataFrame, key: str, others: DataFrame, other_key: str, rule: str, report: str) -> DataFrame:
    """(rule, key) of rows whose key is not among the others'."""
    known = others.select(F.col(other_key).alias("__key")).distinct()
    return rows.join(known, rows[key] == known["__key"], "left_anti").select(F.lit(rule).alias("rule"), F.col(report).alias("key"))


def bijection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only and ids repeated on the left, in one full outer pass over both sides' counts."""
    a = left.groupBy("id").agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy("id").agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, "id", "full")
    return both.agg(F.count_if(F.col("n_right").isNull()).alias("n_only_left"), F.count_if(F.col("n_left").isNull()).alias("n_only_right"), F.count_if(F.col("n_left") > 1).alias("n_repeated"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_violation(rows: DataFrame, run: str, position: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(run, rule, position) of the least rule, then row, that each run breaks."""
    broken = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(k).alias("k"), F.lit(name).alias("rule"))) for k, (name, rule) in enumerate(rules)]))
    found = rows.select(run, position, F.explode(broken).alias("r"))
    first = found.groupBy(run).agg(F.min(F.struct(F.col("r.k").alias("k"), F.col(position).alias("pos"), F.col("r.rule").alias("rule"))).alias("f"))
    return first.select(run, F.col("f.rule").alias("rule"), F.col("f.pos").alias(position))
