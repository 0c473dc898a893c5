"""Phrase mining against plain counts of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrases, queries
from tidemark.llm.common import work_dir

from .helpers import AWKWARD


def pieces(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, least, longest, top, covered=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for w in pieces(text):
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f.update(("und" if lang is None else lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    gone = set()
    for (lang, y), c in found.items():
        for k in range(2, len(y)):
            gone |= {(lang, y[i : i + k]) for i in range(len(y) - k + 1) if 100 * c >= covered * f[lang, y[i : i + k]]}
    out = []
    for lang in n:
        best = []
        for (g, p), a in found.items():
            if g == lang and (g, p) not in gone:
                score, cut = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j) for j in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def made(n, seed):
    r = random.Random(seed)
    stock = [" ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(r.randint(2, 7))) for _ in range(12)]
    out = []
    for _ in range(n):
        text = "".join(r.choice([*stock, "É x", "Z", "rare%d" % r.randint(0, 99)]) + r.choice([" ", "\t ", ". ", "\n", ",", "\x0b", "  "]) for _ in range(r.randint(0, 60)))
        out.append((text.upper() if r.random() < 0.1 else text, r.choice(["en", "en", "fr", None, ""])))
    return out


def table(spark, rows):
    rows = [(i, *r, 1, "x", "y", 5) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, key string, seed string, n int")


@pytest.mark.parametrize(("n", "least", "longest", "top", "covered"), [(120, 4, 5, 2000, 100), (120, 3, 3, 7, 80), (0, 2, 5, 10, 100)])
def test_against_plain_counts(spark, n, least, longest, top, covered):
    rows = made(n, least) + ([(r[1], r[2]) for r in AWKWARD] * 3 if n else [])
    got = phrases.collocations(table(spark, rows).repartition(3), work_dir(spark), least, longest, top, covered).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, longest, top, covered)


def test_failures_of_the_border_are_followed_up(spark, monkeypatch):
    """A sample that sees nothing proposes nothing; passes go on until they find no more."""
    rows = made(60, 9)
    docs = table(spark, rows)
    held = phrases.rows_of(docs, work_dir(spark))
    monkeypatch.setattr(phrases, "RATE", 1)
    assert phrases.frequent(held, 5, 5, work_dir(spark))[2] == 1
    monkeypatch.setattr(phrases, "RATE", 1_000_000)
    found, _, passes = phrases.frequent(held, 5, 5, work_dir(spark))
    assert passes == 6  # words, then a length a pass, then none
    assert found.count() == found.select("key").distinct().count()
    got = phrases.collocations(docs, work_dir(spark), 5, 5, 50).collect()
    assert sorted(map(tuple, got)) == plain(rows, 5, 5, 50)


def test_crowded_filters_and_small_buffers_change_nothing(spark, monkeypatch):
    rows = made(80, 4)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "BITS", 1)
    monkeypatch.setattr(phrases, "HELD", 100)
    monkeypatch.setattr(phrases, "AT_ONCE", 300)
    got = phrases.collocations(table(spark, rows), work_dir(spark), 4, 5, 50).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 5, 50)


def test_scores_beyond_64_bits(spark):
    rows = [("x y. " * 150, "en")] + [("x z " * 50_000, "en")]
    got = phrases.collocations(table(spark, rows), work_dir(spark), 100, 5, 50, scale=10**15).collect()
    want = {r.phrase: r for r in got}
    n = 300 + 200_000 // 2
    assert want["x y"].score == 10**15 * 150 * n // (50_150 * 150)


def test_adding_up_and_packing():
    keys, n, row = phrases._added(np.array([5, 3, 5], np.uint64), np.array([2, 1, 4]), np.array([9, 8, 7]))
    assert (keys.tolist(), n.tolist(), row.tolist()) == ([3, 5], [1, 6], [8, 7])
    r = random.Random(1)
    for size in (1, 7, 255, 256, 2**40, 2**63):
        x = np.array([r.randrange(size) for _ in range(50)], np.uint64)
        assert (phrases._unpacked(phrases._packed(x)) == x).all()
    keys = np.array(sorted(r.randrange(2**64) for _ in range(999)), np.uint64)
    held = phrases._blocks(keys, np.arange(1, 1000), np.arange(10**12, 10**12 + 999), 6).to_pylist()
    assert len(held) == 64 and {x["block"] for x in held} == set(range(64))
    back = [np.cumsum(phrases._unpacked(x["keys"]), dtype=np.uint64) + np.array(x["first"], np.int64).view(np.uint64) for x in held]
    assert (np.concatenate(back) == keys).all()


def test_query(spark, tmp_path):
    rows = made(900, 2)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op13_phrases(spark, str(tmp_path)).collect())) == plain(rows, 100, 5, 2000)
