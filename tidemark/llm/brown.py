"""Brown class-based bigrams: exchange clustering of words, then smoothed log probabilities of texts.

A text is its words, A-Z lower-cased, and one end. Its probability is the product over
tokens of P(class | class before) * P(word | class), both smoothed by addition; before
the first word stands the end's class.

Every word of any text has a class. The UNIT_WORDS most frequent training words are
units of their own; all other words, unseen ones too, fall into SUFFIXES units by a hash
of their last three bytes. Exchange clustering moves units between CLASSES classes. It
is the predictive, distributable kind: neighbours count by CONTEXTS fixed groups (the
most frequent words each by itself, the rest together by unit number), so that no move
makes counts stale. A Spark job counts each unit's neighbours over the whole training
text; with those the driver (units and groups are fixed in number, whatever the corpus
holds) goes through the units SWEEPS times and moves each to the class under which
neighbours on both sides are likeliest. A second job counts class bigrams. The end keeps
a class for itself.

Word counts are exact for every word. The most frequent ones, HEAD at most, are sent to
the tasks: those from a frequency on that a histogram of all counts gives, so nothing is
sorted. Rarer ones, whose frequency has no hot keys left, are joined by word.

Null text is an empty one: the end alone. A row with a null doc_id is learned from.
Repeated rows count and score each. A very long text is one sequence; 256 texts are worked
on at a time. Ties in frequency go by the word's bytes. Without
training rows all words are unseen. An empty table gives no rows. Columns besides doc_id
and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

UNIT_WORDS, SUFFIXES, CONTEXTS, CLASSES, SWEEPS, HEAD, ALPHA = 8192, 1024, 64, 64, 4, 200_000, 0.5
#: Distinct words that a task counts before it passes their counts on.
COUNTED = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8; bytes.split takes exactly the six white space characters."""
    return text.translate(_LOWER).split() if text else []


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; counts are added up in tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) >= COUNTED:
                    yield out()
                    held = Counter()
        yield out()

    return _texts(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, most of them at most, with their counts: by falling count, then by bytes."""
    step = F.floor(F.log2("n") * 32)  # steps of about 2 %, some two thousand in all
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("step").desc()).collect()
    taken, least = 0, None
    for row in sizes:
        taken += row.words
        if taken > most:
            break
        least = row.step
    if least is None:
        return [], np.zeros(0, np.int64)
    rows = counts.where(step >= F.lit(least)).toArrow()  # most rows at most
    held = sorted(zip((-rows["n"].to_numpy()).tolist(), rows["word"].to_pylist(), strict=True))
    return [word for _, word in held], -np.array([n for n, _ in held], np.int64)


def suffix_unit(word: bytes, own: int, suffixes: int) -> int:
    return 1 + own + zlib.crc32(word[-3:]) % suffixes


class Lookup:
    """Places of tokens among the frequent words, and units of all tokens. Unit 0 is the end."""

    def __init__(self, words: list[bytes], counts: np.ndarray, own: int, suffixes: int):
        self.place = {word: k for k, word in enumerate(words)}
        self.own, self.suffixes = min(own, len(words)), suffixes
        self.counts = counts
        units = np.arange(1, len(words) + 1)
        units[self.own :] = [suffix_unit(word, self.own, suffixes) for word in words[self.own :]]
        self.units = units.astype(np.int32)
        self.n_units = 1 + self.own + suffixes

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place (-1: not frequent) and unit of each word."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        units = self.units[place] if len(self.units) else np.zeros(len(words), np.int32)
        for k in np.flatnonzero(place < 0):
            units[k] = suffix_unit(words[k], self.own, self.suffixes)
        return place, units


def neighbours(sequences: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit, tokens of it by the group or class before and by that after, over all sequences (units as unsigned 16-bit integers, each sequence with its end)."""
    n = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(2 * n * n_classes, np.int64), classes.astype(np.int64)
        for batch in batches:
            held = [x for x in batch.column(0).to_pylist() if x]
            after = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
            before = np.concatenate(([0], after[:-1]))  # what precedes a sequence is the end of another
            for at in range(0, len(after), 1 << 20):
                a, b = after[at : at + (1 << 20)], before[at : at + (1 << 20)]
                total += np.bincount(np.concatenate((a * n_classes + kind[b], (n + b) * n_classes + kind[a])), minlength=len(total))
        place = np.flatnonzero(total)
        for at in range(0, len(place), 100_000):
            part = place[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["place", "n"])

    found = sequences.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # units times classes at most
    out = np.zeros(2 * n * n_classes)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out[: n * n_classes].reshape(n, n_classes), out[n * n_classes :].reshape(n, n_classes)


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """One sweep of the exchange algorithm over the units; unit 0 stays alone in class 0. before, after: a unit's neighbours by group."""

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    classes, around = classes.copy(), np.hstack([before, after])
    sizes = before.sum(axis=1)
    held = np.zeros((around.shape[1], n_classes))  # neighbours of each class by group, on either side
    np.add.at(held.T, classes, around)
    totals = np.bincount(classes, sizes, n_classes)
    value = f(held)
    for u in range(1, len(classes)):
        if not sizes[u]:
            continue
        at = np.flatnonzero(around[u])
        own, was = around[u, at], classes[u]
        held[at, was] -= own
        value[at, was] = f(held[at, was])
        totals[was] -= sizes[u]
        gain = (f(held[at] + own[:, None]) - value[at]).sum(axis=0) - 2 * (f(totals + sizes[u]) - f(totals))
        gain[0] = -np.inf
        best = int(np.argmax(gain))
        classes[u] = best
        held[at, best] += own
        value[at, best] = f(held[at, best])
        totals[best] += sizes[u]
    return classes


class Model:
    """What scoring needs: frequent words with counts and units, classes, and log10 of transitions and class sizes."""

    def __init__(self, lookup: Lookup, classes: np.ndarray, transitions: np.ndarray, class_log: np.ndarray, train_tokens: int, distinct: int, ends: int):
        self.lookup, self.classes, self.transitions, self.class_log = lookup, classes, transitions, class_log
        self.train_tokens, self.distinct, self.ends = train_tokens, distinct, ends
        self.base_log = np.log10(train_tokens + distinct + 1)


def train(docs: DataFrame, path: str) -> tuple[Model, DataFrame]:
    """The model of docs, and their word counts (word, n)."""
    spark = docs.sparkSession
    counts = saved(word_counts(docs), f"{path}/counts")
    ends = docs.count()
    seen = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    words, frequent = frequent_words(counts, HEAD)
    lookup = Lookup(words, frequent, UNIT_WORDS, SUFFIXES)
    shared = spark.sparkContext.broadcast(lookup)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                lists = [tokens(text.as_py()) for text in batch.column(0).slice(at, 256)]
                units = known.of([w for x in lists for w in x])[1].astype("<u2")
                cuts = np.cumsum([0, *map(len, lists)])
                packed = [units[a:b].tobytes() + b"\0\0" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["units"])

    sequences = saved(_texts(docs).select("text").mapInArrow(encode, "units binary"), f"{path}/units")
    n_classes = max(2, min(CLASSES, lookup.n_units))
    classes = 1 + np.arange(lookup.n_units) % (n_classes - 1)
    classes[0] = 0
    groups = np.arange(lookup.n_units)
    groups[CONTEXTS // 2 :] = CONTEXTS // 2 + groups[CONTEXTS // 2 :] % (CONTEXTS - CONTEXTS // 2)
    before, after = neighbours(sequences, groups, CONTEXTS)
    for _ in range(SWEEPS):
        classes = exchange(before, after, classes, n_classes)
    before, _ = neighbours(sequences, classes, n_classes)
    pairs = np.zeros((n_classes, n_classes))
    np.add.at(pairs.T, classes, before)
    transitions = np.log10((pairs + ALPHA) / (pairs.sum(axis=1, keepdims=True) + ALPHA * n_classes))
    # distinct words of each class: frequent words by their own units, all others by suffix
    suffixes = counts.groupBy(F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(SUFFIXES)).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("v")).collect()
    distinct = np.zeros(lookup.n_units)
    for row in suffixes:
        distinct[1 + lookup.own + row.s] += row.v
    for word in words[: lookup.own]:
        distinct[suffix_unit(word, lookup.own, SUFFIXES)] -= 1
    distinct[1 : 1 + lookup.own] = 1
    distinct[0] = 1 if ends else 0
    sizes = np.bincount(classes, before.sum(axis=1), n_classes) + np.bincount(classes, distinct, n_classes) + 1
    return Model(lookup, classes, transitions, np.log10(sizes), int(seen.n or 0) + ends, seen.v + bool(ends), ends), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probabilities) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rid = shared.value, TaskContext.get().partitionId() << 40
        frequent = np.log10(np.append(m.lookup.counts, 0) + 1.0)  # the last: not frequent
        end_log = np.log10(m.ends + 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                lists = [tokens(text.as_py()) for text in batch.column(1).slice(at, 256)]
                words = [w for x in lists for w in x]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                place, units = m.lookup.of(words)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                kind = m.classes[units]
                previous = np.zeros(len(words), np.int64)
                previous[1:] = kind[:-1]
                previous[cuts[:-1][sizes > 0]] = 0
                last = np.where(sizes > 0, kind[np.maximum(cuts[1:] - 1, 0)] if len(words) else 0, 0)
                numerator = frequent[place]
                own = np.array([numerator[a:b].sum() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                each = m.transitions[previous, kind] - m.class_log[kind]
                classed = np.array([each[a:b].sum() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                known = np.array([(place[a:b] >= 0).sum() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.int64) + (m.ends > 0)
                rare = [Counter(words[k] for k in a + np.flatnonzero(place[a:b] < 0)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                base = own + end_log - (sizes + 1) * m.base_log
                text = own + classed + end_log + m.transitions[last, 0] - m.class_log[0]
                columns = [pa.array(np.arange(rid, rid + len(lists))), batch.column(0).slice(at, 256), pa.array(sizes + 1), pa.array(known), pa.array(base, pa.float64()), pa.array(text, pa.float64()), pa.array([list(x.items()) for x in rare], pa.map_(pa.binary(), pa.int64()))]
                rid += len(lists)
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    kinds = "rid long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare map<binary,long>"
    held = saved(_texts(docs).mapInArrow(run, kinds), f"{path}/held")
    rare = held.select("rid", F.explode("rare").alias("word", "times")).join(counts, "word")
    found = rare.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("seen"))
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    joined = held.drop("rare").join(found, "rid", "left")
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + seen).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def held_out(parts: int, part: int, doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
