import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest

from tidemark.llm import common, line_runs, mixing, queries, warc
from tidemark.llm.common import work_dir

from .helpers import WORD, awkward, prose

SPACE = " \t\n\x0b\x0c\r"


def dedup(texts, min_chars, min_docs):
    def key(line):
        line = line.strip(SPACE)
        return "".join(c.lower() if c.isascii() else c for c in line)

    seen = {}
    for text in texts:
        for k in {key(x) for x in (text or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    gone = {k for k, n in seen.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 5, None])
@pytest.mark.parametrize("min_chars,min_docs", [(1, 2), (0, 3), (6, 2)])
def test_line_dedup(spark, batches, min_chars, min_docs):
    docs = awkward(spark)
    got = line_runs.drop_shared_lines(docs, min_chars, min_docs, batches).collect()
    rows = docs.collect()
    want = dedup([r.text for r in rows], min_chars, min_docs)
    assert sorted(map(repr, ((r.row.doc_id, r.row.ids, r.kept, r.n_lines, r.n_dropped) for r in got))) == sorted(map(repr, ((r.doc_id, r.ids, *w) for r, w in zip(rows, want, strict=True))))


def test_line_dedup_of_nothing(spark):
    assert line_runs.drop_shared_lines(awkward(spark, []), batches=3).collect() == []


def test_levels_are_compacted(spark):
    runs = line_runs.LineRuns(spark, work_dir(spark), threshold=4)
    for k in range(13):
        runs.add(spark.createDataFrame([(1, 1), (2, 2), (3, k)], "a long, b long"))
    assert all(len(v) < line_runs.FANOUT for v in [*runs.levels.values(), runs.settled])
    assert set(runs.compacted) == {1, 2}
    assert {(r.a, r.b) for r in runs.shared().collect()} == {(1, 1), (2, 2)}


def test_the_query_compacts_its_runs_and_merges_without_a_shuffle(spark, sf, monkeypatch):
    made, plans = [], []
    start, merged = line_runs.LineRuns.__init__, line_runs.LineRuns._merged
    monkeypatch.setattr(line_runs.LineRuns, "__init__", lambda self, *a: (made.append(self), start(self, *a))[1])
    monkeypatch.setattr(line_runs.LineRuns, "_merged", staticmethod(lambda runs: plans.append(merged(runs)) or plans[-1]))
    queries.op8_line_dedup(spark, sf).count()
    assert made[0].compacted and plans
    runs = line_runs.LineRuns(spark, work_dir(spark), 2)
    some = [runs._run(spark.createDataFrame([(k, 1, 1)], "a long, b long, n long")) for k in range(3)]
    assert "Exchange" not in merged(some)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_text_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs = awkward(spark, [(k, "same\nline", "s") for k in range(20)] + [(99, "other\nline", "s")])
    got = line_runs.drop_shared_lines(docs, 1, 5).collect()
    assert sorted((r.row.doc_id, r.kept, r.n_dropped) for r in got) == [(k, "", 2) for k in range(20)] + [(99, "other", 1)]


def test_warc_round_trip(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100, "x" * 1000
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (9, "http://b", big), (3, "http://c", None), (4, "http://d", ""), (5, "u", "same"), (6, "u", "same"), (None, "n", other), (7, "r", other), (7, "r", other)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    path = work_dir(spark)
    warc.write_archives(pages, path)
    got = warc.transactions(warc.read_archives(spark, path)).collect()
    assert len(got) == len(rows)
    ids = {r.capture_id: r.metadata.fields.get("page-id") for r in got}
    seen = []
    for r in got:
        assert r.request.concurrent_to == r.metadata.concurrent_to == r.capture_id
        seen.append((ids[r.capture_id], r.response.type, ids.get(r.response.refers_to), r.response.digest, int(r.metadata.fields["payload-bytes"]), None if r.response.payload is None else bytes(r.response.payload).decode()))
    want = []
    answered = set()
    for page_id, _, html in sorted(rows, key=lambda r: -(r[0] or 0)):
        html = html or ""
        size = len(html.encode())
        top = str(max(r[0] or 0 for r in rows if (r[2] or "") == html))
        revisit = size >= 1000 and html in answered
        answered.add(html)
        want.append((None if page_id is None else str(page_id), "revisit" if revisit else "response", top if revisit else None, "sha1:" + hashlib.sha1(html.encode()).hexdigest(), size, None if revisit else html))
    assert sorted(map(repr, seen)) == sorted(map(repr, want))


def test_archives_are_members_at_their_offsets_in_files_closed_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    r = random.Random(1)
    rows = [(k, f"http://h/{k}", "".join(r.choice("abcdefgh ") for _ in range(2000))) for k in range(30)]
    path = work_dir(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    files = spark.read.parquet(f"{path}/files").collect()
    assert len(files) > 4 and max(f.n_bytes for f in files) < 6000
    seen = set()
    for f in files:
        data = Path(f"{path}/archives/{f.file}").read_bytes()
        assert f.file.endswith(".warc.gz") and len(data) == f.n_bytes
        found = list(warc.members(io.BytesIO(data), 100))
        assert len(found) == f.n_records and warc.parse(found[0][1])["type"] == "warcinfo"
        for (at, content), end in zip(found, [x for x, _ in found[1:]] + [len(data)], strict=True):
            assert gzip.decompress(data[at:end]) == content
        assert gzip.decompress(data) == b"".join(content for _, content in found)
        seen |= {warc.parse(content)["payload"] for _, content in found}
    assert {html.encode() for _, _, html in rows} <= seen
    # what a lost attempt left behind is not read
    Path(f"{path}/archives/part-lost.warc.gz").write_bytes(b"cut off")
    assert warc.read_archives(spark, path).count() == 90


def test_warc_of_nothing(spark):
    path = work_dir(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.transactions(warc.read_archives(spark, path)).collect() == []


def levels(sizes, weights, share, most):
    cap = {s: most * n for s, n in sizes.items()}
    target, free, left = {}, dict(weights), share * sum(sizes.values())
    while free:
        total = sum(free.values())
        over = [s for s in free if left * free[s] / total >= cap[s]]
        if not over:
            return target | {s: left * w / total for s, w in free.items()}
        for s in over:
            target[s] = cap[s]
        left -= sum(cap[s] for s in over)
        for s in over:
            free.pop(s)
    return target


@pytest.mark.parametrize("rows", [None, [], "prose"])
@pytest.mark.parametrize("block", [4096, 3])
def test_mixing_meets_targets(spark, rows, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = prose(120) if rows == "prose" else rows
    docs = awkward(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    assert len(got) == docs.count()
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = levels(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= 1
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_pivot_is_fair_and_keeps_sums():
    total, n = 0.0, 4000
    for seed in range(n):
        parts, held = mixing.pivot([10, 20, 10], [0.3, 0.5, 0.4], [seed * 7919, seed * 104729 + 1, seed + 5])
        assert abs(parts[0] * 10 + parts[1] * 20 + parts[2] * 10 - 17) < 1e-6
        assert sum(0 < p < 1 for p in parts) <= 1
        total += parts[0]
    assert abs(total / n - 0.3) < 0.03


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_archives_lie_where_spark_resolves_their_path(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/w"
    assert warc.qualified(spark, path) == f"file:{tmp_path}/w"
    assert warc.filesystem(warc.qualified(spark, path))[1] == f"{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(1, "u", "<p>"), (2, "v", None)], "page_id long, url string, html string"), path)
    listed = {r.file for r in spark.read.parquet(f"{path}/files").collect()}
    assert listed and listed <= {p.name for p in (tmp_path / "w/archives").iterdir()}
    assert warc.transactions(warc.read_archives(spark, path)).count() == 2
