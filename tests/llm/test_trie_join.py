"""The prefix-tree join against all pairs of sets."""

import random

import numpy as np
import pytest

from tidemark.llm import queries, trie_join

from .helpers import AWKWARD, WORD, awkward


def shingles(text, width=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())


def plain(rows, percent=80):
    """(doc_id, set size, component) of each row, by brute force."""
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))
    changed = True
    linked = [[j for j, y in enumerate(sets) if x and 100 * len(x & y) >= percent * len(x | y)] for x in sets]
    while changed:
        changed = False
        for i, near in enumerate(linked):
            least = min([group[i], *(group[j] for j in near)])
            changed, group[i] = changed or least < group[i], least
    least = {}
    for g, (d, _) in zip(group, rows, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(map(repr, ((d, len(x), least.get(g)) for g, (d, _), x in zip(group, rows, sets, strict=True))))


def edited(n, seed):
    """Families of texts with a few words changed, shared passages, and texts of their own."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    bases = [[f"w{r.randint(0, 3000)}" for _ in range(r.choice([3, 6, 30, 90, 200]))] for _ in range(n // 8 + 1)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 1 + len(w) // 25)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9)}"
        at = r.randrange(len(w))
        w = w[:at] + passage + w[at:] if r.random() < 0.3 else w
        rows.append((i, (" " if r.random() < 0.9 else "\t\n").join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("crowd", [2_000_000, 900, 60])
def test_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(trie_join, "CROWD", crowd)  # with small crowds sets meet by window, and by blocks
    rows = edited(300, crowd) + [(r[0], r[1]) for r in AWKWARD]
    held = awkward(spark, [(*r, "s") for r in rows]).repartition(5)
    got = trie_join.similar_documents(held, trie_join_path(spark)).collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows)


def trie_join_path(spark):
    from tidemark.llm.common import work_dir

    return work_dir(spark)


def test_query(spark, tmp_path):
    rows = edited(120, 5)
    awkward(spark, [(*r, "s") for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(repr, map(tuple, queries.op12_jaccard(spark, str(tmp_path)).collect()))) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (2, " \n")]])
def test_nothing_to_link(spark, rows):
    got = trie_join.similar_documents(awkward(spark, [(*r, "s") for r in rows]), trie_join_path(spark)).collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("percent", [50, 80, 100])
def test_forest_joins_what_all_pairs_join(seed, percent):
    r = random.Random(seed)
    sets = [sorted(r.sample(range(30), r.randint(1, 25))) for _ in range(60)]
    for _ in range(60):
        x = set(r.choice(sets))
        x.symmetric_difference_update(r.sample(range(40), 2))
        sets.append(sorted(x or {1}))
    sets += sets[:5]
    more = [r.randint(0, 2) for _ in sets]  # windows of the set alone count, but are not stored
    starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    n = np.array([len(x) + m for x, m in zip(sets, more, strict=True)])
    pairs = trie_join.forest(np.array([v for x in sets for v in x], np.int64), starts, n, percent)

    def joined(links):
        group = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in links:
                group[a] = group[b] = min(group[a], group[b])
        return group

    def alike(i, j):
        inter = len(set(sets[i]) & set(sets[j]))
        return 100 * inter >= percent * (n[i] + n[j] - inter)

    want = [(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j)]
    assert all(alike(i, j) for i, j in pairs)
    assert joined(pairs) == joined(want)


def test_partners_share_enough_of_their_first_windows():
    """The bound of step 1 holds for all pairs of sizes and least overlaps."""
    for n in range(1, 80):
        p_first, _ = trie_join._first(n, 80)
        least = trie_join.needed(n, 80)
        k = trie_join._first(least, 80)[1]
        for m in range(least, n * 100 // 80 + 1):
            inter = -(-80 * (n + m) // 180)
            assert inter >= least
            # at worst the windows that are not shared come first
            assert min(p_first, n) - (n - inter) >= k
