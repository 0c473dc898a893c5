"""Phrase collocations by Toivonen's mining: a sample proposes, one pass over everything counts, failures of the border are followed up.

A text, A-Z lower-cased, is cut into pieces at BREAKS and those into words at blanks and tabs.
Everything is per language; a null one is ``und``. A phrase, 1 to ``longest`` words within a
piece, is known by 61 bits of a hash of its language and words, and its length, so counts are exact
but for a chance of 2^-61 for each two phrases of a length.

1. A sample of the rows is mined level by level with a threshold lowered to a half. What it
   finds often enough, with each phrase all its parts, is the proposal.
2. One pass over all texts counts the proposed phrases and their negative border: the phrases
   that are not proposed although both of their parts (all words but the last, all but the
   first) are. All words are counted, so that n, the words of a language, is exact.
3. A border phrase that is frequent is a failure: longer ones may have gone unseen. As long as a
   pass finds new frequent phrases, another pass counts those whose parts are now known to be
   frequent and that no pass before has counted. When a pass finds none, every frequent phrase
   is known, for all parts of a frequent phrase are frequent.

The families of a pass go to the tasks as a filter of two bits a phrase and 2^31 bits (256 MB) at
most. It may take a phrase for a member that is none; that only counts more phrases, in all
passes alike. Beyond some 10^8 phrases the filter passes more and more of them, up to all, which
the shuffle then counts: results stay exact. Tasks add up what they have seen before they send it,
sorted and in blocks by the first bits of the keys: a block is a row of packed differences, about
nine bytes a phrase, and the blocks of the same bits are added up together.

Edge cases: null and empty texts have no words. Texts of one language count together whatever
their rows; repeated rows count as often as they are there. Ties go by the phrase's UTF-8 bytes.
A very long text is read whole by one task, at a hundred bytes of memory for each of its own. An
empty table gives no rows. Columns besides text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, text_of
from .text_features import _LOWERED, _mixed
from .word_windows import byte_class, longer, parts, words

BREAKS = byte_class(b".,;:!?\n\x0b\x0c\r")
APART = BREAKS | byte_class(b" \t")
#: Bits of a filter for each member, and of a filter at most.
BITS, MOST_BITS = 16, 1 << 31
#: Bytes of text looked at at once, phrases that a task adds up before it sends them on.
AT_ONCE, HELD = 1_000_000, 1_500_000
#: The sample is one row in RATE; it proposes what it holds half as often as a frequent phrase would be, twice at least.
RATE = 8
#: Keys of phrases that are sent to the rows which are asked for them, at most.
ASKED = 1_000_000


def rows_of(docs: DataFrame, path: str) -> DataFrame:
    """row (a number of its own), lang, seed (the language's hash) and text of each row of docs."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return saved(docs.select(F.monotonically_increasing_id().alias("row"), lang.alias("lang"), F.xxhash64(lang).bitwiseAND(F.lit(-8)).alias("seed"), text_of().alias("text")), path)


class Family:
    """A filter of phrases: two of its bits are set for each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.last = bits, np.uint64(8 * len(bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in (keys & self.last, keys >> np.uint64(32) & self.last):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def family(keys: DataFrame) -> Broadcast:
    """The filter of the phrases of keys, built in Spark and broadcast: BITS a phrase, MOST_BITS in all at most."""
    size = 1 << max(15, min(MOST_BITS, BITS * max(1, keys.count())).bit_length())
    size = min(size, MOST_BITS)
    at = F.array(F.col("key").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(size - 1)))
    place = keys.select(F.explode(at).alias("p")).select((F.col("p") + 1).alias("p"))
    pieces = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for b, held in pieces.collect():  # 4096 bytes each, size // 8 together at most
        bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(held, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _pieces(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (with its language), text, first byte and piece of each word."""
    hashes, owner, at = words(data, offsets, APART)
    return _mixed(hashes ^ seeds[owner]), owner, at, np.cumsum(BREAKS[data])[at] + owner if len(data) else at


def _key(windows: np.ndarray, k: int) -> np.ndarray:
    """What phrases of k words are known by: their hashes, with k in the last three bits."""
    return windows & ~np.uint64(7) | np.uint64(k)


def _in_scope(hashes: np.ndarray, piece: np.ndarray, lengths: range, families: list[Family]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, key) of the phrases of each of these lengths whose parts, and theirs, are all of the last family, and not all of one before."""
    window = hashes
    # whether the phrase that begins here is in one piece and in scope, for each family
    inside = [np.ones(len(hashes), bool) for _ in families or [None]]
    for k in range(1, lengths.stop):
        if k > 1:
            same = piece[k - 1 :] == piece[: len(piece) - k + 1]
            for i, held in enumerate(families):
                at = np.flatnonzero(inside[i])
                member = np.zeros(len(window), bool)
                member[at[held.has(_key(window[at], k - 1))]] = True
                inside[i] = member[:-1] & member[1:] & same
            window = longer(window, hashes)
        if not inside[-1].any():
            return
        if k in lengths:
            new = inside[-1].copy()
            for earlier in inside[:-1]:
                new &= ~earlier
            at = np.flatnonzero(new)
            yield at, _key(window[at], k)


def _added(keys: np.ndarray, n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal keys together, with the first of their rows; keys ascend."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(first):
        return keys, n, row
    return keys[first], np.add.reduceat(n[order], first), np.minimum.reduceat(row[order], first)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each in as few bytes as the largest needs; how many these are comes first."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    out = np.zeros(((len(held) - 1) // held[0], 8), np.uint8)
    out[:, : held[0]] = np.frombuffer(held, np.uint8, offset=1).reshape(-1, held[0])
    return out.view("<u8").ravel()


def _blocks(keys: np.ndarray, n: np.ndarray, row: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row for each value of the keys' first bits: differences of keys, counts and rows, packed. keys ascend."""
    first = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, first[1:] != first[:-1])[: len(first)])
    ends = np.append(starts[1:], len(keys))
    out: list[tuple] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append((int(first[a]), int(keys[a : a + 1].view(np.int64)[0]), _packed(np.diff(keys[a:b], prepend=keys[a])), _packed(n[a:b]), int(row[a:b].min()), _packed(row[a:b] - row[a:b].min())))
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["block", "first", "keys", "n", "least", "row"])


def counted(rows: DataFrame, lengths: range, families: list[Broadcast], least: int) -> DataFrame:
    """key, k (words), n (occurrences) and row (one that has it) of each phrase in scope that occurs least times or more; with lengths from 1, a language's words under its seed as k 0."""
    bits = max(4, (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        filters = [Family(x.value) for x in families]

        def together() -> tuple:
            return _added(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            numbers, seeds = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for at, data, offsets in parts(batch.column(2), AT_ONCE):
                seed, number = seeds[at : at + len(offsets) - 1], numbers[at : at + len(offsets) - 1]
                hashes, owner, _, piece = _pieces(data, offsets, seed)
                found = [_added(keys, np.ones(len(keys), np.int64), number[owner[first]]) for first, keys in _in_scope(hashes, piece, lengths, filters)]
                if 1 in lengths:
                    found.append((seed, np.bincount(owner, minlength=len(seed)), number))
                held += found
                size += sum(len(x[0]) for x in found)
                if size > HELD:
                    held = [together()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield _blocks(*held[0], bits)
                        held, size = [], 0
        if size:
            yield _blocks(*together(), bits)

    def total(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("first", "keys", "n", "least", "row")]
        keys = np.concatenate([np.cumsum(_unpacked(x), dtype=np.uint64) + np.array(f, np.int64).view(np.uint64) for f, x in zip(*columns[:2], strict=True)])
        row = np.concatenate([_unpacked(x).view(np.int64) + f for f, x in zip(*columns[3:], strict=True)])
        keys, n, row = _added(keys, np.concatenate([_unpacked(x).view(np.int64) for x in columns[2]]), row)
        k = (keys & np.uint64(7)).astype(np.int8)
        kept = (n >= least) | (k == 0)
        return pa.table({"key": pa.array(keys[kept].view(np.int64)), "k": pa.array(k[kept]), "n": pa.array(n[kept]), "row": pa.array(row[kept])})

    each = rows.select("row", "seed", "text").mapInArrow(run, "block int, first long, keys binary, n binary, least long, row binary")
    return each.groupBy("block").applyInArrow(total, "key long, k byte, n long, row long")


def proposed(rows: DataFrame, least: int, longest: int, path: str) -> DataFrame:
    """key of each phrase that the sample holds often enough; so are its parts."""
    sample = saved(rows.where(F.pmod(F.xxhash64("row"), F.lit(RATE)) == 0), f"{path}/sample")
    enough = max(2, least // (2 * RATE))
    found: DataFrame | None = None
    for k in range(1, longest + 1):
        families = [family(found)] if found is not None else []
        level = saved(counted(sample, range(k, k + 1), families, enough).where("k > 0").select("key"), f"{path}/level={k}")
        found = level if found is None else found.union(level)
        if level.isEmpty():
            break
    return found


def frequent(rows: DataFrame, least: int, longest: int, path: str) -> tuple[DataFrame, DataFrame, int]:
    """key, k, n and row of each phrase that occurs least times or more; seed and n (words) of each language; how many passes it took."""
    proposal = proposed(rows, least, longest, f"{path}/proposal")
    families = [family(proposal)]
    first = saved(counted(rows, range(1, longest + 1), families, least), f"{path}/pass=1")
    found, new, passes = first.where("k > 0"), first.where("k > 0").join(proposal, "key", "left_anti"), 1
    while not new.isEmpty():
        passes += 1
        families.append(family(found))
        new = saved(counted(rows, range(2, longest + 1), families, least), f"{path}/pass={passes}")
        found = found.union(new)
    return found, first.where("k = 0").select(F.col("key").alias("seed"), "n"), passes


def described(rows: DataFrame, found: DataFrame, longest: int) -> DataFrame:
    """key, lang, seed, phrase and cuts (keys l and r of both parts, by the words of the first) of each phrase of found of two words or more."""
    phrases = found.where("k > 1")
    wanted = phrases.groupBy("row").agg(F.collect_list("key").alias("keys"))
    # few enough go to the texts; else both are shuffled
    wanted = F.broadcast(wanted) if phrases.count() <= ASKED else wanted

    def signed(held: np.ndarray, i: int, k: int) -> int:
        return int(_key(held[i : i + 1], k).view(np.int64)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, langs = batch.column(1).to_numpy().view(np.uint64), batch.column(2)
            for at, data, offsets in parts(batch.column(3), AT_ONCE):
                here = slice(at, at + len(offsets) - 1)
                keys = np.unique(batch.column(4)[here].flatten().to_numpy().view(np.uint64))
                hashes, owner, first, piece = _pieces(data, offsets, seeds[here])
                low = _LOWERED[data]
                apart = np.append(np.flatnonzero(APART[data]), len(data))
                # the word's own text ends before the next byte between words, and with its text at the latest
                ends = np.minimum(apart[np.searchsorted(apart, first)], offsets[owner + 1])
                windows = [hashes]
                for _ in range(longest - 1):
                    windows.append(longer(windows[-1], hashes))
                out: list[tuple] = []
                for k in range(2, longest + 1):
                    held = _key(windows[k - 1], k)
                    places = np.flatnonzero((piece[k - 1 :] == piece[: len(piece) - k + 1])[: len(held)])
                    places = places[np.isin(held[places], keys)]
                    for i in places[np.unique(held[places], return_index=True)[1]].tolist():
                        phrase = b" ".join(low[first[j] : ends[j]].tobytes() for j in range(i, i + k)).decode("utf-8", "replace")
                        cuts = [{"l": signed(windows[j - 1], i, j), "r": signed(windows[k - j - 1], i + j, k - j)} for j in range(1, k)]
                        t = at + int(owner[i])
                        out.append((signed(windows[k - 1], i, k), langs[t].as_py(), int(seeds[t].view(np.int64)), phrase, cuts))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 5, KINDS, strict=True)], ["key", "lang", "seed", "phrase", "cuts"])

    joined = rows.join(wanted, "row").select("row", "seed", "lang", "text", "keys")
    # a phrase may be met by a row that was not asked for it
    return joined.mapInArrow(run, "key long, lang string, seed long, phrase string, cuts array<struct<l: long, r: long>>").dropDuplicates(["key"])


KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("l", pa.int64()), ("r", pa.int64())]))]


def collocations(docs: DataFrame, path: str, least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100, scale: int = 1000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the top phrases of two words or more of each language.

    A phrase occurs a >= least times; of its cuts in two, of l and r occurrences, that of the lowest score floor(scale * a * n / (l * r))
    counts, the first of equal ones. A phrase goes if a longer one that holds it occurs at least covered % as often as it.
    path: a new folder that all executors share.
    """
    spark: SparkSession = docs.sparkSession
    rows = rows_of(docs, f"{path}/rows")
    found, totals, _ = frequent(rows, least, longest, path)
    counts = found.select("key", F.col("n").alias("a"))
    told = saved(described(rows, found, longest).join(counts, "key"), f"{path}/told")
    # of the longer phrases around one, those a word longer are at least as frequent as the others
    around = told.select(F.explode(F.array(F.element_at("cuts", -1)["l"], F.element_at("cuts", 1)["r"])).alias("key"), F.col("a").alias("longer"))
    around = around.groupBy("key").agg(F.max("longer").alias("longer"))
    left = told.join(around, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    cut = left.select("key", "lang", "seed", "phrase", "a", F.posexplode("cuts").alias("cut", "x")).select("*", "x.l", "x.r").drop("x")
    cut = cut.join(counts.toDF("l", "of_l"), "l").join(counts.toDF("r", "of_r"), "r").join(totals, "seed")
    # the products may pass 64 bits; a, n < 2^55 keep them within 38 digits
    score = F.expr(f"(CAST(a AS decimal(17, 0)) * CAST(n AS decimal(17, 0)) * {scale}) div (CAST(of_l AS decimal(18, 0)) * CAST(of_r AS decimal(18, 0)))")
    best = cut.groupBy("key", "lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", F.col("of_l").alias("l"), F.col("of_r").alias("r"))).alias("x"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
