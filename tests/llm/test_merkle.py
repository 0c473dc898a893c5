"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries
from tidemark.llm.common import work_dir

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KINDS = "doc_id long, text string, lang string, source string, n_chars long, g string, rank int, node string, path string, hash string, keep int, n int"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    return sha(*[part(row[c]) for c in FIELDS])


def proofs(hashes, fanout):
    """Root and, for each leaf, its levels of (left, right) siblings."""
    paths, level, places = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        for k, at in enumerate(places):
            first = at - at % fanout
            paths[k].append((level[first:at], level[at + 1 : first + fanout]))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        places = [at // fanout for at in places]
    return level[0], paths


def plain(rows, fanout):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = proofs([x[2] for x in groups[name]], fanout)
    root, above = proofs([trees[name][0] for name in names], fanout)
    out = []
    for name, up in zip(names, above, strict=True):
        subroot, paths = trees[name]
        for (_, _, own, row), path in zip(groups[name], paths, strict=True):
            d, whole = row["doc_id"], path + up
            if d is not None and row["n_chars"] is not None and zlib.crc32(str(d).encode()) % 7 == 0:
                h = leaf({**row, "n_chars": row["n_chars"] + 1})
            else:
                h = own
            for left, right in whole:
                h = sha(*left, h, *right)
            out.append((d, own, subroot, root, sha(*[x for left, right in whole for x in left + right]), h))
    return out


def made(n, langs, seed):
    r = random.Random(seed)
    return [{"doc_id": r.choice([None, *range(n)]) if i % 5 == 0 else i, "text": r.choice([None, "", "naïve 中文\n" * r.randint(1, 40), f"text {i}"]), "lang": r.choice(langs), "source": r.choice([None, "s"]), "n_chars": r.choice([None, 5, 9])} for i in range(n)]


def table(spark, rows):
    clash = {"g": "x", "rank": 1, "node": "n", "path": "p", "hash": "h", "keep": 2, "n": 3}
    names = [x.split()[0] for x in KINDS.split(", ")]
    return spark.createDataFrame([tuple({**row, **clash}[c] for c in names) for row in rows], KINDS)


@pytest.mark.parametrize(("n", "langs", "fanout", "digits"), [(0, [None], 2, 3), (1, ["x"], 2, 6), (90, [None, "", "en", "Z", "é"], 2, 2), (70, ["en"], 3, 2), (65, ["a", None], 8, 1)])
def test_against_a_plain_tree(spark, monkeypatch, n, langs, fanout, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = made(n, langs, n)
    rows += [dict(rows[0])] * 3 if n > 2 else []  # equal rows are leaves of their own
    held = merkle.manifest(table(spark, rows), work_dir(spark), FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id"), "row": F.struct("n_chars", "rank")}, fanout)
    got = held.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(), merkle.folded(F.col("leaf"))).collect()
    want = [x[:5] for x in plain(rows, fanout)] if rows else []
    assert sorted(map(repr, (tuple(x)[:5] for x in got))) == sorted(map(repr, want))
    assert all(x[5] == x[3] for x in got)


def test_query(spark, tmp_path):
    rows = made(300, ["en", "en", "de", None], 3)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(x)[:6] for x in got))) == sorted(map(repr, plain(rows, 2)))
    assert 0 < sum(not x.verified for x in got) < 200
    assert all(x.verified == (x.folded_root == x.root) for x in got)


def test_proofs_are_made_without_joins_and_blocks_are_shuffled_once(spark):
    nodes = spark.range(1000).select(F.when(F.col("id") >= 0, "a").alias("g"), F.col("id").alias("rank"), (F.col("id") * 0 + 1000).alias("n"), F.sha1(F.col("id").cast("string")).alias("hash"), F.struct("id").alias("keep"))
    levels = merkle.rollup(nodes, 2, work_dir(spark))
    facts = spark.range(1).select(F.lit("a").alias("g"), F.array().cast(merkle.PATH).alias("path"), F.lit("r").alias("root"))
    plan = merkle.descended(levels, facts, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    written = []
    saved, merkle.saved = merkle.saved, lambda df, path: written.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, path)
    try:
        merkle.rolled(nodes, 2, work_dir(spark))
    finally:
        merkle.saved = saved
    assert written[0].count("Exchange") == 1
