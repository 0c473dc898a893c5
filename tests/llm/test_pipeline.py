import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import mixing, near_dedup, quality
from tidemark.llm.common import work_dir

from .helpers import WORD, awkward, prose
from .test_lines_warc_mixing import dedup


def windows(text, width=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())


def groups(texts, least=0.8):
    """Brute force: component of each text under the similarity of its windows."""
    sets, group = [windows(t) for t in texts], list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= least * len(a | b):
                group[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def edited(text, every, seed):
    r = np.random.default_rng(seed)
    words = text.split(" ")
    for k in range(int(r.integers(0, every)), len(words), every):
        words[k] = f"new{r.integers(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 3])
@pytest.mark.parametrize("rows", [None, [], "prose"])
def test_one_document_of_each_group_stays(spark, rows, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    if rows == "prose":
        base = [(i, t, s) for i, t, s in prose(12, seed=4, longest=600) if len(t.split()) > 100]
        rows = base + [(100 + 10 * i + k, edited(t, e, k), s) for i, t, s in base for k, e in enumerate((90, 80, 70, 12, 5))] + [(1000 + i, t, s) for i, t, s in base]
    docs = awkward(spark, rows)
    held = docs.collect()
    got = near_dedup.keep_one(docs, work_dir(spark)).collect()
    assert got == [] if not held else set(got[0].asDict()) == set(docs.columns)
    group = groups([r.text for r in held])
    want = {}
    for r, g in zip(held, group, strict=True):
        want[g] = min(want.get(g, (float("inf"),)), (float("inf") if r.doc_id is None else r.doc_id,))
    assert sorted(str(r.doc_id) for r in got) == sorted("None" if x == float("inf") else str(x) for (x,) in want.values())


@pytest.mark.parametrize("block", [512, 40])
def test_edits_alike_only_through_their_original(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = np.random.default_rng(5)
    original = [f"w{k}" for k in range(200)]
    rows = [(1000, " ".join(original), "a")]
    for k in range(300):
        words = original.copy()
        for at in r.choice(np.arange(5, 195, 5), 3, replace=False):
            words[at] = f"new{k}x{at}"
        rows.append((k, " ".join(words), "a"))
    sets = [windows(t) for _, t, _ in rows]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets[1:21]) for b in sets[1 : i + 1]]
    assert 0.7 < np.median(alike) < 0.8 and min(len(a & sets[0]) / len(a | sets[0]) for a in sets[1:]) > 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [x.doc_id for x in near_dedup.keep_one(docs, work_dir(spark)).collect()] == [0]


def test_whole_documents_are_mixed(spark):
    docs = awkward(spark, prose(150) + [(1, "same row", "src0")] * 2)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    sizes, taken = {}, {}
    for r in docs.collect():
        sizes.setdefault(r.source, []).append(len(WORD.findall(r.text)))
    for r in got.collect():
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
    for r in mixing.mix(docs).select("source", "target").distinct().collect():
        assert abs(taken.get(r.source, 0) - r.target) <= max(sizes[r.source])


def test_rows_that_differ_in_one_column_stay_themselves(spark):
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "de"), (1, "a b c", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sorted(map(str, (r.lang for r in mixing.mixed_documents(docs, share=1.0).collect())))
    assert got == ["None", "de", "en"]  # one source of rate 1: each row once


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, names = {r.doc_id: r for r in docs.collect()}, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "pack"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, sf)
    assert kept.columns == docs.columns
    failed = {r.row.doc_id for r in quality.ledger(docs).collect() if r.failed}
    first = kept.orderBy("doc_id").collect()
    assert [r.doc_id for r in first] == sorted(set(rows) - failed)
    lined = stage["line_dedup"](spark, kept, sf).orderBy("doc_id").collect()
    assert [r.text for r in lined] == [text for text, _, _ in dedup([r.text for r in first], 1, 10)]
    single = stage["simhash_near_dedup"](spark, spark.createDataFrame(lined, docs.schema), sf)
    group = groups([r.text for r in lined])
    left = {r.doc_id for r in single.collect()}
    assert left == {min(r.doc_id for r, h in zip(lined, group, strict=True) if h == g) for g in set(group)}
    mixed = stage["mix_sources"](spark, single, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= left
    assert sum(r.length for r in stage["pack"](spark, mixed, sf).collect()) > 0


def test_run_has_every_row_of_the_mix(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    again = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert got and key(got) == key(again)
