"""Frames of the visual segments against a plain walk over the whole table of images."""

from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.plans import inputs, runs


def test_frames_show_the_whole_table(spark, sf):
    hashes = {r.vec_id: r.h for r in inputs.frames(spark, sf).select("vec_id", V.average_hash(F.col("px")).alias("h")).collect()}
    ids = sorted(hashes)
    got = {r.id: r.hash for r in runs._frames(spark, sf).select("id", "hash").collect()}
    want = {r.seg_id: hashes[ids[r.seg_id // 3 % len(ids)]] for r in inputs.visual(spark, sf).select("seg_id").collect()}
    assert got == want and len({k // 3 % len(ids) for k in got}) > 6
