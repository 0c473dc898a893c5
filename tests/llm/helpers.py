"""Small fixtures with the awkward cases: nulls, empties, ties, repeats, long texts, clashing names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

AWKWARD = [
    (1, "a b c\nshared line\n", "s1"),
    (2, None, "s1"),
    (3, "", None),
    (4, "  Shared LINE \t\nother\n\n", "s2"),
    (5, "word " * 5000, "s2"),
    (6, "word " * 5000, "s2"),
    (7, "naïve  café\x0b\x0cx y\r\n<|endoftext|> don't 12345 中文", None),
    (7, "naïve  café\x0b\x0cx y\r\n<|endoftext|> don't 12345 中文", None),
    (None, "shared line", "s3"),
    (9, "\n\n\n", "s3"),
]


def awkward(spark, rows=None):
    """The rows with extra columns whose names clash with those that operators make."""
    rows = AWKWARD if rows is None else rows
    kinds = "doc_id long, text string, source string, size string, row string, key int, ids string, places string, n_words string, `group` string"
    return spark.createDataFrame([(*r, "x", "y", 1, None, "z", "w", "g") for r in rows], kinds)


def prose(n, seed=1, words=("the", "of", "and", "ship", "harbour", "rain", "stone", "lamp", "river", "road"), longest=400):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(words) + str(r.randint(0, 40)) for _ in range(r.randint(0, longest))), f"src{r.randint(0, 4)}") for i in range(n)]
