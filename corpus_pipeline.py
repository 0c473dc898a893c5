"""A corpus from raw documents to packed sequences: STAGES, each on all that the one before kept.

* ``quality_rules`` rejects documents that fail policy ``web-1`` of the rule ledger.
* ``line_dedup`` drops lines found in ten documents or more from every document.
* ``simhash_near_dedup`` keeps the document of the smallest doc_id of each near-duplicate
  group. Windows are of five words; fingerprints within four bits are candidates, and a
  document goes only if its set of windows has a similarity (Jaccard) of 0.8 or more to
  that of one that is kept.
* ``mix_sources`` repeats or leaves out whole documents, so that each source comes near
  its target; a document that is taken twice has two rows.
* ``pack`` cuts and packs the ids of all documents into sequences of 2048.

All stages but the last return the columns of documents, in their order; n_chars, where
it is there, is that of the text after line_dedup.

Edge cases, by stage: a null or empty text fails ``few_words`` and goes in quality_rules;
a text that line_dedup empties stays as an empty one; empty texts are copies of one
another, and of equal rows (nulls, ties in doc_id) one stays in simhash_near_dedup;
mix_sources gives a document without words no copy and puts the null source last; pack
cuts a very long text into many pieces. An empty table passes through all stages as one.
Extra columns come through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_runs, mixing, near_dedup, packing, quality
from tidemark.llm.common import saved, work_dir
from tidemark.llm.tokens import default_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.ledger(docs).where(quality.passes("web-1")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_runs.drop_shared_lines(docs, min_chars=1, min_docs=10)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("row.text").isNotNull(), F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return left.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, work_dir(spark), width=5, radius=4, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs, default_vocabulary(), end_id=1, capacity=2048)
    crc = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Random rounding and byte-level ids have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"{path}/stage={k}")
    return docs
