import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import brown, queries
from tidemark.llm.common import work_dir

from .helpers import WORD, awkward, prose


def tokens(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(train, docs, model):
    """Scores word by word; the model's classes are taken as they are."""
    counts = Counter(w for t in train for w in tokens(t))
    ends = len(train)
    n, v = sum(counts.values()) + ends, len(counts) + bool(ends)

    def cls(word):
        return int(model.classes[model.lookup.of([word.encode()])[1][0]])

    n_classes = model.transitions.shape[0]
    sizes = np.ones(n_classes)
    sizes[0] += ends + bool(ends)
    for w, c in counts.items():
        sizes[cls(w)] += c + 1
    pairs = np.full((n_classes, n_classes), brown.ALPHA)
    for t in train:
        kinds = [0, *map(cls, tokens(t)), 0]
        for a, b in zip(kinds, kinds[1:]):
            pairs[a, b] += 1
    pairs /= pairs.sum(axis=1, keepdims=True)
    out = []
    for d, t in docs:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        score, last = 0.0, 0
        for x in w:
            score += math.log10(pairs[last, cls(x)] * (counts[x] + 1) / sizes[cls(x)])
            last = cls(x)
        score += math.log10(pairs[last, 0] * (ends + 1) / sizes[0])
        out.append((d, len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), base, score))
    return n, out


@pytest.mark.parametrize("rows", [None, [], "prose"])
@pytest.mark.parametrize("head,units", [(200_000, 8192), (9, 4)])
def test_scores_are_those_of_plain_loops(spark, rows, head, units, monkeypatch):
    for name, value in (("HEAD", head), ("UNIT_WORDS", units), ("SUFFIXES", 16), ("CLASSES", 6), ("CONTEXTS", 8), ("COUNTED", 50)):
        monkeypatch.setattr(brown, name, value)
    rows = prose(60) if rows == "prose" else rows
    docs = awkward(spark, rows)
    path = work_dir(spark)
    model, counts = brown.train(docs.where(~brown.held_out(7, 2)), f"{path}/train")
    got = brown.score(docs, model, counts, f"{path}/score").collect()
    all_rows = docs.collect()
    train = [r.text for r in all_rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    n, want = plain(train, [(r.doc_id, r.text) for r in all_rows], model)
    assert model.train_tokens == n
    key = lambda r: (str(r[0]), r[1], round(r[3], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9) if want else not got


def test_frequent_words_by_a_histogram(spark):
    counts = spark.createDataFrame([(bytes([97 + k]), 2 ** (k // 2)) for k in range(20)], "word binary, n long")
    for most in (0, 1, 2, 5, 20, 30):
        words, n = brown.frequent_words(counts, most)
        assert len(words) <= most and (len(words) >= most - 1 or most > 20)
        assert n.tolist() == sorted(n.tolist(), reverse=True) and set(words) == {bytes([97 + k]) for k in range(20 - len(words), 20)}
    assert brown.frequent_words(counts.limit(0), 5)[0] == []


def test_exchange_finds_the_classes_of_an_alternating_text():
    # units 1-3 and 4-6 take turns, so two classes of three tell what comes next
    r = np.random.default_rng(0)
    text = [u for _ in range(3000) for u in (r.integers(1, 4), r.integers(4, 7))] + [0]
    classes = np.array([0, 1, 2, 1, 2, 1, 2])
    before, after = np.zeros((7, 7)), np.zeros((7, 7))
    for a, b in zip([0, *text], text):
        before[b, a] += 1
        after[a, b] += 1
    for _ in range(4):
        classes = brown.exchange(before, after, classes, 3)
    assert len(set(classes[1:4])) == len(set(classes[4:7])) == 1 and classes[1] != classes[4]


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_class_lm(spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s / got.n > got.b / got.n + 0.1
