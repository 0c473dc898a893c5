"""The tables as timelines: views are visual segments, all other events transcript segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import timeline

NEAREST, LONGEST, LAST = 3600, 7200, 600
#: Ids of images that are ranked together.
RANGE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seg_id"), seconds().alias("s"), "event_type", "value")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type <> 'view'")
    return rows.withColumn("e", F.col("s") + 60 * (1 + F.col("seg_id") % 400))


def visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).where("event_type = 'view'")
    return timeline.lead_segments(points, LONGEST, LAST).withColumn("at", F.col("s"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and px, the vector as an 8 by 8 gray image."""
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.pixels(F.col("embedding")).alias("px"))


def placed_frames(spark: SparkSession, sf_dir: str, faces: DataFrame) -> DataFrame:
    """faces (by vec_id) with ``place``, the rank of vec_id among all images, from 0, and ``n_images``.

    The rank is counted in ranges: one number a range meets in a window, the rest ranks within its range."""
    ids = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").select("vec_id").distinct()
    ranges = ids.select("vec_id", F.floor(F.col("vec_id") / RANGE).alias("range"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "n_images": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    inside = F.row_number().over(Window.partitionBy("range").orderBy("vec_id")) - 1
    places = ranges.withColumn("inside", inside).join(before, "range")
    return faces.join(places.select("vec_id", (F.col("before") + F.col("inside")).alias("place"), "n_images"), "vec_id")


def shown(segments: DataFrame, images: DataFrame, every: int = 1) -> DataFrame:
    """Segments (seg_id, ...) with the image that each shows: by its id, modulo the number of images; ``every`` ids in a row show one. images: from placed_frames()."""
    n = images.agg(F.max("n_images").alias("n"))
    wanted = segments.crossJoin(F.broadcast(n)).withColumn("place", F.pmod(F.floor(F.col("seg_id") / every), F.col("n"))).drop("n")  # n is one row
    return wanted.join(images.drop("n_images"), "place").drop("place")


#: The same inputs in the oracle's SQL.
SQL = """
ev AS (SELECT user_id AS run_id, event_id AS seg_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type, value FROM events),
tr AS (SELECT *, s + 60 * (1 + seg_id % 400) AS e FROM ev WHERE event_type <> 'view'),
vi AS (SELECT *, s AS at, row_number() OVER (PARTITION BY run_id ORDER BY s, seg_id) AS idx,
       least(s + 7200, coalesce(lead(s) OVER (PARTITION BY run_id ORDER BY s, seg_id), s + 600)) AS e FROM ev WHERE event_type = 'view'),
fr AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor(128 + 256 * CAST(x AS DOUBLE)))) AS INTEGER)) AS px FROM embeddings)
"""
