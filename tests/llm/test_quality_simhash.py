from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import near_dedup, quality, simhash
from tidemark.llm.common import saved, work_dir
from tidemark.llm.components import components

from .helpers import WORD, awkward, prose


def measure(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("rows", [None, [], "prose"])
@pytest.mark.parametrize("place", [21, 4])
def test_ledger(spark, rows, place, monkeypatch):
    monkeypatch.setattr(quality, "_LOW", (1 << place) - 1)  # with few bits, long texts take the other branch
    rows = [(i, t + " " + t[: i * 3] + "\n#x|\n#x|", s) for i, t, s in prose(60, words=("a", "b"), longest=150)] if rows == "prose" else rows
    docs = awkward(spark, rows)
    got = quality.ledger(docs).collect()
    want = [(r.doc_id, r.n_words, *measure(r.text)) for r in docs.collect()]
    assert sorted(map(repr, ((r.row.doc_id, r.row.n_words, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) == sorted(map(repr, want))
    for r in got:
        assert bool(r.failed & quality.BASE) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_ablations(spark):
    masks = [0, 1, 1, 2, 3, 4, 16]
    held = spark.createDataFrame([(m,) for m in masks], "failed long")
    got = {r.rule: r for r in quality.ablations(held, "base-1").collect()}
    assert set(got) == {"few_words", "repeated_windows"}
    few = got["few_words"]
    assert (few.n_failed, few.n_failed_alone, few.n_kept, few.n_kept_without) == (3, 2, 3, 5)
    assert quality.ablations(held.limit(0), "web-1").collect() == []


def fingerprint(text, width):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    windows = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in windows]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius):
    """Brute force: prints is a list of (doc_id, fingerprint); the smallest doc_id that each row reaches."""
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, x) in enumerate(prints):
            for j, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= radius and group[j] < group[i]:
                    group[i], changed = group[j], True
    least = {}
    for g, (d, _) in zip(group, prints, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [least.get(g) for g in group]


def test_masks_cover_every_pair_within_the_radius():
    r = np.random.default_rng(1)
    found = [m & (2**64 - 1) for m in simhash.masks(4)]
    assert len(found) == 31
    for _ in range(3000):
        places = r.choice(64, r.integers(0, 5), replace=False)
        difference = sum(1 << int(p) for p in places)
        assert any(difference & m == 0 for m in found)


@pytest.mark.parametrize("block", [1024, 2])
@pytest.mark.parametrize("rows", [None, [], "prose"])
def test_near_duplicates(spark, rows, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    if rows == "prose":
        base = prose(12, longest=300)
        rows = base + [(100 + i, t + " end", s) for i, t, s in base] + [(200 + i, t, s) for i, t, s in base] + [(300 + i, f"{base[0][1]} {i}", "s") for i in range(15)]
    docs = awkward(spark, rows)
    got = simhash.near_duplicates(docs, work_dir(spark), width=4, radius=4)
    got = got.select("doc_id", simhash.hexadecimal().alias("f"), "component_id").collect()
    prints = sorted(((r.doc_id, fingerprint(r.text, 4)) for r in docs.collect()), key=repr)
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, classes(prints, 4), strict=True)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    links = spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(links, work_dir(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert components(links.limit(0), work_dir(spark)).collect() == []


def sent_after_explode(df):
    """Explodes below the broadcasts of a plan: Spark sizes their rows as if there were none."""
    found, within = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        within = None if within is not None and depth <= within else within
        if "BroadcastExchange" in line:
            within = depth if within is None else within
        elif "Generate explode" in line and within is not None:
            found.append(line)
    return found


def test_exploded_tables_are_never_broadcast(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    prints = saved(spark.range(3000).select(F.xxhash64("id").alias("fingerprint")), f"{work_dir(spark)}/prints")
    assert sent_after_explode(simhash.links(prints, 4)) == []
    texts = saved(spark.range(300).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("t"), F.repeat(F.lit("x"), 512).cast("binary").alias("sig")), f"{work_dir(spark)}/texts")
    assert sent_after_explode(near_dedup.candidates(texts, 0.8)) == []
