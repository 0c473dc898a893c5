"""Greedy chunks against a plain loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains


def plain(rows, longest, most, order):
    """rows: (run, s, e, seg_id) -> the same with chunk."""
    out, runs = [], {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            runs.setdefault(r[0], []).append(r)
    for items in runs.values():
        k, start, n = 0, 0, 0
        for r in sorted(items, key=lambda r: [r[i] for i in order]):
            if k == 0 or r[2] - start > longest or (most and n >= most):
                k, start, n = k + 1, r[1], 0
            n += 1
            out.append((*r, k))
    return sorted(map(repr, out))


def made(seed, n, runs, long, falls=False):
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += r.choice([0, 0, 1, 3, 9, 40 if r.random() < 0.1 else 2]) * (-1 if falls and r.random() < 0.2 else 1)
        rows.append((r.choice(runs), t, t + (r.randint(0, 400) if r.random() < long else r.randint(0, 12)), i))
    return rows


@pytest.mark.parametrize(("n", "runs", "long", "longest", "most", "block", "part"), [
    (0, [1], 0, 30, None, 4096, 100_000), (300, [1, 2, None], 0.05, 30, None, 4096, 100_000), (900, [1, 1, 1, 2, None], 0.05, 30, None, 7, 50),
    (700, [1], 0.0, 60, 4, 5, 90), (700, [1, 2], 0.3, 5, None, 3, 40), (500, [3], 0.02, 100_000, None, 4, 30), (400, [3], 0.5, 0, 1, 4, 30),
])
def test_chunks(spark, monkeypatch, n, runs, long, longest, most, block, part):
    monkeypatch.setattr(chains, "STRETCH", part)
    monkeypatch.setattr(chains, "BLOCK", block)
    rows = made(n, n, runs, long) + ([(1, None, 5, -1), (1, 5, None, -2)] if n else [])
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "run_id long, s long, e long, seg_id long, pos string, succ int")
    got = chains.chunked(table, ["run_id"], longest, most).select("run_id", "s", "e", "seg_id", "chunk").collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows, longest, most, (1, 3, 2))


@pytest.mark.parametrize("most", [1, 4])
def test_chunks_in_an_order_that_is_not_that_of_time(spark, monkeypatch, most):
    monkeypatch.setattr(chains, "STRETCH", 40)
    monkeypatch.setattr(chains, "BLOCK", 5)
    rows = made(5, 300, [1, 2], 0.1, falls=True)
    table = spark.createDataFrame(rows, "run_id long, s long, e long, seg_id long")
    got = chains.chunked(table, ["run_id"], 25, most, ("seg_id", "s", "e")).collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows, 25, most, (3, 1, 2))


def test_a_run_of_a_million_items(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("run_id"), (F.col("id") * 3 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("s"), "id")
    rows = rows.select("run_id", "s", (F.col("s") + 1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9))).alias("e"), F.col("id").alias("seg_id"))
    began = time.time()
    got = chains.chunked(rows, ["run_id"], 240.0).groupBy("chunk").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))
    found = sorted(map(tuple, got.collect()))
    assert time.time() - began < 120  # a minute on an idle machine
    assert sum(x[3] for x in found) == 1_000_000 and [x[0] for x in found] == list(range(1, len(found) + 1))
    assert all(e - s <= 240 for _, s, e, _ in found)
    assert all(b[1] + 10 - a[1] > 240 for a, b in zip(found, found[1:]))
