"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

One pass over the texts writes each document's line keys (128-bit hashes); documents
then come in batches of those. A batch's keys are counted once a document, keys of the
settled runs are merge-anti-joined away, and the rest is written as a run of level 0.
Whenever a level holds FANOUT runs they are merged into one run of the next level, and
keys that reach the threshold move to a settled run; settled runs are merged likewise.
Runs are tables bucketed and sorted by key, so that neither merge nor anti-join shuffles
them. After the last batch, what remains is merged once, and every line whose key is
settled is dropped from every document.

A line's key is the line without white space at its ends, A-Z lower-cased. A null
or empty text is one empty line. Repeated rows are documents of their own; the rows of
one text are dealt over tasks where they are many. A very long text or line is one row
of Spark. An empty table gives an empty result. Input columns are kept as they are and
may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, joined_to_facts, let, saved, text_key, text_of, work_dir

#: Runs that a level holds before they are merged into one of the next.
FANOUT = 3
#: Documents of a batch; there are BATCHES at least, so that a level fills.
BATCH, BATCHES = 50_000_000, FANOUT + 1
#: Up to so many shared lines are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 1_000_000
KEY, TEXT = ["a", "b"], ["ta", "tb"]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keys_of(text: Column, min_chars: int) -> Column:
    """One key for each line, null for a line too short to count."""

    def key(line: Column) -> Column:
        stripped = F.btrim(line, F.lit(SPACE_CHARS))
        return F.when(F.char_length(stripped) >= min_chars, F.struct(F.xxhash64(stripped).alias("a"), F.xxhash64(F.lit("line"), stripped).alias("b")))

    return F.transform(lines_of(ascii_lower(text)), key)


class LineRuns:
    """The runs: tables in a folder that all executors share, a file for each bucket of keys."""

    def __init__(self, spark: SparkSession, path: str, threshold: int):
        self.spark, self.path, self.threshold = spark, path, threshold
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as counts are dealt to
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: dict[int, list[DataFrame]] = {}
        self.settled: list[DataFrame] = []
        self.compacted: list[int] = []  # the level of each run that came of a merge

    def _run(self, counts: DataFrame) -> DataFrame:
        self.made += 1
        name = f"{self.name}_{self.made}"
        writer = counts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/run={self.made}")
        writer.saveAsTable(name)
        return self.spark.table(name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Counts of equal keys added up; runs are dealt alike, so nothing is shuffled."""
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def _place(self, run: DataFrame, level: int) -> None:
        """Takes a written run into a level, less the keys that reach the threshold: those make a settled run."""
        self.settled.append(self._run(run.where(F.col("n") >= self.threshold)))
        if len(self.settled) >= FANOUT:
            self.settled = [self._run(self._merged(self.settled))]
        self.levels.setdefault(level, []).append(run.where(F.col("n") < self.threshold))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: a row for each key of each document."""
        # written before it meets the settled runs, for Spark would push the anti-join below the count, where keys are hot
        run = self._run(keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
        for known in self.settled:
            run = run.join(known.hint("merge"), KEY, "left_anti")
        self._place(run, 0)
        level = 0
        while len(self.levels.get(level, [])) >= FANOUT:
            merged = self._run(self._merged(self.levels.pop(level)))
            level += 1
            self.compacted.append(level)
            self._place(merged, level)

    def shared(self) -> DataFrame:
        """Every key in at least threshold documents, once."""
        runs = [run for level in self.levels.values() for run in level]
        if len(runs) > 1:
            self.levels = {}
            self._place(self._run(self._merged(runs)), max(self.compacted, default=0) + 1)
        out = saved(self._merged(self.settled).select(*KEY), f"{self.path}/shared")
        for k in range(1, self.made + 1):
            self.spark.sql(f"DROP TABLE {self.name}_{k}")  # the files stay
        return out


def shared_lines(lines: DataFrame, min_docs: int, batches: int, path: str) -> DataFrame:
    """Keys (a, b) in at least min_docs rows of lines: keys (an array of a, b) by batch, from 0 on."""
    runs = LineRuns(lines.sparkSession, path, min_docs)
    for k in range(batches):
        part = lines.where(F.col("batch") == k).select(F.explode(F.array_distinct("keys")).alias("key"))
        runs.add(part.where("key IS NOT NULL").select("key.*"))
    return runs.shared()


def drop_shared_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, batches: int | None = None, text: str = "text") -> DataFrame:
    """The rows of docs with ``row`` (a struct of their columns as they were), ``kept`` (text without the shared lines), ``n_lines`` and ``n_dropped``."""
    path, n = work_dir(docs.sparkSession), docs.count()
    batches = batches or BATCHES + n // BATCH
    held = docs.select(text_of(text).alias("text"))
    lines = held.select(*text_key(F.col("text")), keys_of(F.col("text"), min_chars).alias("keys"))
    lines = lines.withColumn("batch", F.pmod(F.xxhash64(F.lit("batch"), *TEXT), F.lit(batches)).cast("int"))
    lines = saved(lines, f"{path}/lines", "batch")
    shared = shared_lines(lines, min_docs, batches, path)
    if shared.count() <= BROADCAST_LINES:
        shared = F.broadcast(shared)
    # rows with equal texts lose equal lines, so the text's key is enough
    places = lines.select(*TEXT, F.posexplode("keys").alias("place", "key")).where("key IS NOT NULL").select(*TEXT, "place", "key.*")
    hits = places.join(shared, KEY, "left_semi").groupBy(*TEXT, "place").agg(F.count(F.lit(1)).alias("copies"))
    hits = hits.groupBy(*TEXT).agg(F.collect_list("place").alias("places"), F.max("copies").alias("copies"))
    hits = saved(hits, f"{path}/hits")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text).alias("text"))
    joined = joined_to_facts(whole.select("*", *text_key(F.col("text"))), hits, TEXT, n, "left")
    split, gone = lines_of(F.col("text")), F.col("places")
    rest = let(split, lambda held: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(held) - 1), gone), lambda i: held[i]), "\n"))
    return joined.select(
        "row",
        F.when(gone.isNull(), F.col("text")).otherwise(rest).alias("kept"),
        F.size(split).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )
