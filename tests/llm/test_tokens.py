import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, queries, token_store
from tidemark.llm.common import work_dir
from tidemark.llm.tokens import default_vocabulary, encoder, pieces_of

from .helpers import awkward, prose


@pytest.fixture(scope="module")
def code():
    """The library's own tokenizer, loaded anew and left as it is."""
    return Tokenizer.from_file(default_vocabulary())


FRESH = Tokenizer.from_file(default_vocabulary())


def plain(code, text):
    return code.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "<|endoftext|>", "<|endoftext", "|>", "a", "don't"]) | st.text(alphabet=st.sampled_from(" \t\n\r\x0b\x1c\x1d\x85\xa0 　ab'sZ1!.é中|_"), max_size=30) | st.text(max_size=20), max_size=4).map("".join), max_size=5))
def test_ids_are_the_tokenizers(texts):
    got = encoder(default_vocabulary()).texts(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(FRESH, t) for t in texts]


def test_an_added_token_has_its_id(code):
    got = encoder(default_vocabulary()).texts(pa.array(["a <|endoftext|> b"]))
    assert np.frombuffer(got[0], "<u4").tolist() == plain(code, "a <|endoftext|> b") == [64, 220, 50256, 275]


def test_other_settings_go_to_the_tokenizer_whole(tmp_path):
    texts = ["A Word  and <|endoftext|>", "Don't\n stop", ""]
    settings = json.loads(FRESH.to_str())
    prefixed = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    for name, change in {"lower": {"normalizer": {"type": "Lowercase"}}, "prefix": {"pre_tokenizer": prefixed}}.items():
        path = str(tmp_path / f"{name}.json")
        Path(path).write_text(json.dumps(settings | change))
        got = encoder(path).texts(pa.array(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(Tokenizer.from_file(path), t) for t in texts]
    other = str(Path(default_vocabulary()).parent / "word_bpe_49k.json")
    got = encoder(other).texts(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(Tokenizer.from_file(other), t) for t in texts]


def test_slices_cover_all():
    texts = pa.array(["x" * 10, None, "", "y" * 50, "z"], pa.string())
    assert [t for p in pieces_of(texts, 12) for t in p.to_pylist()] == texts.to_pylist()


@pytest.mark.parametrize("rows", [None, [], "prose"])
def test_store_round_trip(spark, code, rows):
    rows = prose(60) if rows == "prose" else rows
    docs, path = awkward(spark, rows), work_dir(spark)
    token_store.write_tokens(docs, path, default_vocabulary(), end_id=2)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    want = sorted([(r.doc_id, [*plain(code, r.text), 2]) for r in docs.collect()], key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(d), ids) for d, ids in want)
    for doc_id in (5, 7, 12345):
        assert sorted(token_store.read_document(spark, path, doc_id)) == sorted(ids for d, ids in want if d == doc_id)


def test_the_dictionary_is_trained_and_does_not_depend_on_the_order_of_rows(spark):
    rows = [(7, f"text {k} of one id, {'again ' * (k % 9)}", "s") for k in range(50)]
    found = {token_store.train_dictionary(awkward(spark, r).repartition(n).select("doc_id", "text"), default_vocabulary(), 2) for r, n in ((rows, 1), (rows[::-1], 3))}
    assert len(found) == 1 and found.pop()[:4] == b"\x37\xa4\x30\xec"  # a trained dictionary's magic number
    assert token_store.train_dictionary(awkward(spark, []).select("doc_id", "text"), default_vocabulary(), 2) == b""


def test_store_refuses_wide_ids_and_wrong_dictionaries(spark):
    path = work_dir(spark)
    with pytest.raises(Exception, match="does not fit"):
        token_store.write_tokens(awkward(spark), path, default_vocabulary(), end_id=70_000)
    with pytest.raises(ValueError, match="another dictionary"):
        token_store._open(b"TDMK\x01\x00\x02\x00" + b"0" * 32 + b"\0\0\0\0", b"1" * 32)


def test_first_fit_tree_is_first_fit():
    r = np.random.default_rng(3)
    for _ in range(30):
        lengths = sorted(r.integers(1, 101, r.integers(0, 80)).tolist(), reverse=True)
        bins, offsets = packing.first_fit(lengths, 100)
        free = []
        for length, b, o in zip(lengths, bins, offsets, strict=True):
            want = next((i for i, f in enumerate(free) if f >= length), len(free))
            if want == len(free):
                free.append(100)
            assert (b, o) == (want, 100 - free[want])
            free[want] -= length


@pytest.mark.parametrize("rows", [None, [], "prose"])
def test_packing_holds_every_id_once(spark, code, rows):
    rows = prose(80) if rows == "prose" else rows
    docs = awkward(spark, rows)
    got = packing.pack(docs, default_vocabulary(), capacity=256).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*plain(code, r.text), 1])
    texts = {d: sorted(v) for d, v in want.items()}
    assert sum(r.length for r in got) == sum(len(x) for v in texts.values() for x in v)
    pieces = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 256
        pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for d, v in texts.items():
        assert sorted((s, i) for s, i, _ in pieces[d]) == sorted((s, t[s : s + 256]) for t in v for s in range(0, len(t), 256))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256


def test_groups_stay_small_whatever_the_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 5000)
    rows = [(1, "one very long text " * 2000, "s")] + [(None, "the same row", "s")] * 3000
    got = packing.pack(awkward(spark, rows), default_vocabulary(), capacity=64).collect()
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + r.length
    assert len(groups) > 10 and max(groups.values()) < 4 * sum(groups.values()) / len(groups)
    wide = packing.pack(awkward(spark), default_vocabulary(), end_id=70_000, capacity=64).collect()
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 70_000 for r in wide if r.start + r.length == r.doc_tokens)


def test_queries_agree_with_plain_encoding(spark, sf, code):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    for r in queries.op2_token_store(spark, sf).orderBy("doc_id").collect():
        ids = [*plain(code, docs.pop(r.doc_id)), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not docs
    rows = queries.op5_pack(spark, sf).collect()
    sequences = {}
    for r in rows:
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert sum(sequences.values()) >= 0.97 * 2048 * len(sequences)
