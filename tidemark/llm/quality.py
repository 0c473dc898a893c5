"""Quality rules as a ledger of bits.

Every rule is evaluated once a document. The ledger keeps the measurements and one
long whose bit k is set where rule k fails. A policy is a named, versioned set of
rules, thus a mask: applying one, comparing two or asking what a policy would keep
without one of its rules are bit operations on the ledger, without the texts. All
of it is DataFrame expressions.

Null text has no words, and fails ``few_words`` alone. Ties and repeated rows need no
care, as every row is judged by itself; a very long text is measured whole. An empty
table gives an empty ledger. Input columns are kept in ``row`` whatever their names.

Two 3-word windows are taken as equal if their 64-bit hashes are; within a text of a
million words the odds of a false match are 3 in 10^8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, text_of, words

SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLACE = 21  # bits of a place within a text's windows when hashes and places are sorted together
_LOW = (1 << _PLACE) - 1

#: Rule k of the ledger: name and SQL condition on the measurements under which a document fails. Rules are only ever added at the end.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("capitals", "10 * n_capitals > 6 * word_chars"),
    ("exclamations", "100 * n_exclamations > 40 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("digits", "10 * n_digits > 5 * word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policies by version.
POLICIES = {
    "base-1": BASE,
    "lines-1": BASE | BIT["repeated_lines"],
    "web-1": sum(BIT.values()),
}


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _tail(array: Column, start: int) -> Column:
    return F.slice(array, start, F.greatest(F.size(array), F.lit(1)))


def _neighbours(array: str) -> Column:
    """Structs (x, y) of each element and the next; y is null in the last."""
    return F.arrays_zip(F.col(array).alias("x"), _tail(F.col(array), 2).alias("y"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (the input's columns) and the measurements of each row of docs, as columns of longs."""
    t, w, h = F.col("text"), F.col("w"), F.col("h")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text).alias("text"))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select("row", "text", words(t).alias("w"), lines.alias("lines"))
    windows = F.slice(F.arrays_zip(w.alias("a"), _tail(w, 2).alias("b"), _tail(w, 3).alias("c")), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    out = out.select(
        "row",
        F.size(w).alias("n_words"),
        _without(t, SPACE_CHARS).alias("word_chars"),
        (F.char_length(t) - _without(t, SYMBOLS)).alias("n_symbols"),
        (F.char_length(t) - _without(t, _UPPER)).alias("n_capitals"),
        (F.char_length(t) - _without(t, "0123456789")).alias("n_digits"),
        (F.char_length(t) - _without(t, "!")).alias("n_exclamations"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("h"),
    )
    # sorted together, most of a hash over the place: windows that may recur are neighbours with equal high bits
    # beyond 2^21 windows places do not fit, and all windows are candidates
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))
    out = out.withColumn("packed", F.when(F.size(h) <= _LOW, packed).otherwise(F.array().cast("array<bigint>")))
    near = F.filter(_neighbours("packed"), lambda p: p["x"].bitwiseXOR(p["y"]).bitwiseAND(F.lit(~_LOW)) == 0)
    near = F.array_distinct(F.flatten(F.transform(near, lambda p: F.array(p["x"].bitwiseAND(F.lit(_LOW)), p["y"].bitwiseAND(F.lit(_LOW))))))
    every = F.transform(h, lambda _, i: i.cast("long"))
    out = out.withColumn("near", F.when(F.size(h) <= _LOW, near).otherwise(every))
    # among those, whole hashes decide
    out = out.withColumn("exact", F.sort_array(F.transform("near", lambda i: F.struct(F.get(h, i.cast("int")).alias("h"), i.alias("i")))))
    same = F.filter(_neighbours("exact"), lambda p: p["x"]["h"] == p["y"]["h"])
    out = out.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["x"]["i"], p["y"]["i"]))))))
    covered = F.zip_with("places", _tail(F.col("places"), 2), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3)))
    out = out.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_exclamations"]
    # a generator of one row: a filter on measurements stays above it, and does not repeat the work of all columns below
    return out.select("row", F.inline(F.array(F.struct(*[F.col(n).cast("long").alias(n) for n in names]))))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, the measurements and ``failed``, whose bit k tells that rule k fails."""
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(docs, text).withColumn("failed", failed)


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a document passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(held: DataFrame, policy: str) -> DataFrame:
    """A row for each rule of a policy: documents it fails, fails alone, and those kept with and without it. held: a ledger.

    Documents are first counted by their bits, so what is shuffled is one row for each combination of failures."""
    mask = POLICIES[policy]
    combined = held.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("failed").bitwiseAND(F.col("others")) == 0
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"), F.lit(mask & ~bit).cast("long").alias("others")) for name, bit in BIT.items() if bit & mask])
    n = F.col("n")
    return (
        combined.select("failed", "n", F.explode(rules).alias("r")).select("failed", "n", "r.*").groupBy("rule").agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("failed") == F.col("bit"), n).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("failed") == 0, n).otherwise(0)).alias("n_kept"),
            F.sum(F.when(kept, n).otherwise(0)).alias("n_kept_without"),
        )
    )
