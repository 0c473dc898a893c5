"""Connected components by least labels and pointer jumping; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, label) of every node of links (a, b): the smallest node that it reaches. Nulls are no nodes; no links give no rows.

    A node takes the least label among its neighbours, then that label's own label, so that paths halve with each round."""
    spark = links.sparkSession
    both = links.where("a <> b").select("a", "b")
    both = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{path}/links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), f"{path}/labels=0")
    round_ = 0
    while True:
        round_ += 1
        seen = both.join(labels.withColumnsRenamed({"node": "b", "label": "seen"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(seen, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        lower = lower.join(jump, "label", "left").select("node", F.coalesce(F.least("label", "next"), F.col("label")).alias("label"), "was")
        lower = saved(lower, f"{path}/labels={round_}")
        labels = lower.select("node", "label")
        if not lower.where("label < was").limit(1).count():
            return labels
