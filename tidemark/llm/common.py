"""What the operators share: text classes, table reading, and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python regular expressions of one white space character, of a run, of a word.
SPACE = r"[\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words in order."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it lies in spark.checkpoint.dir, and in a temporary folder only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """df, written to path and read back: its lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    names = [c for c in df.columns if c != partition_by] + ([partition_by] if partition_by else [])
    return spark.read.schema(df.select(*[f"`{c}`" for c in names]).schema).parquet(path)


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as two longs, ta and tb: equal texts have equal keys."""
    return [F.xxhash64(text).alias("ta"), F.xxhash64(F.lit("text"), text).alias("tb")]


#: A key with over this share of all rows, and over HOT_ROWS, is dealt over several tasks.
HOT_SHARE, HOT_ROWS = 10_000, 200


def joined_to_facts(rows: DataFrame, facts: DataFrame, key: list[str], n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined to facts, which has one row a key and ``copies``, the rows of that key in rows (n_rows in all).

    Hot keys are dealt over parts, their fact once for each. There are HOT_SHARE hot keys at most, so that many rows are
    broadcast at most; what meets in a task besides is a HOT_SHARE-th of the rows or HOT_ROWS, whichever is more.
    """
    limit = max(HOT_ROWS, n_rows // HOT_SHARE)
    parts = F.ceil(F.col("copies") / limit).cast("int")
    hot = facts.where(F.col("copies") > limit).select(*key, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__parts").cast("long")), F.lit(0))).drop("__parts")
    spread = facts.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)).cast("long") - 1))).drop("copies")
    return dealt.join(spread, [*key, "__part"], how).drop("__part")


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions for rows at per_partition each, and no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))
