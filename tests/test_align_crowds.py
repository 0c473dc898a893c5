"""Alignment where many segments share their times: as pair by pair, and without a pair for each two of them."""

from pyspark.sql import functions as F

from tidemark.operators import timeline

KEYS = ["run_id", "seg_id"]


def joined_rows(df):
    """The most rows that a join of an executed plan gave."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        if inner is not None:
            return walk(inner)
        own = node.metrics().apply("numOutputRows").value() if "Join" in kind else 0
        children = node.children()
        return max([own, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_equal_segments_meet_once(spark):
    n = 300
    transcript = spark.range(n).select(F.lit(1).alias("run_id"), F.col("id").alias("seg_id"), F.lit(1000).alias("s"), F.lit(1100).alias("e"))
    visual = spark.range(n).select(F.lit(1).alias("run_id"), (F.col("id") + 1).alias("idx"), (F.col("id") + 7).alias("seg_id"), F.lit(1050).alias("s"), F.lit(1200).alias("e"), F.lit(1050).alias("at"))
    out = timeline.align(transcript, visual, 3600, 7200)
    rows = out.collect()
    assert {(r["visual_id"], r["match_reason"], r["overlap_seconds"]) for r in rows} == {(7, "time_overlap", 50.0)} and len(rows) == n
    assert joined_rows(out) <= 2 * n


def test_crowds_are_aligned_as_pair_by_pair(spark):
    import random

    r = random.Random(5)
    t = [(k % 3, k, r.choice([None, *range(0, 60, 10)]), r.choice([None, *range(5, 90, 10)])) for k in range(400)] + [(None, 400, 0, 5)]
    v = [(k % 2, k + 1, 1000 - k, s, s + r.choice([0, 0, 7, 20]), s + r.choice([0, 3])) for k, s in enumerate(r.choice(range(0, 200, 10)) for _ in range(200))]
    transcript, visual = spark.createDataFrame(t, "run_id int, seg_id int, s int, e int"), spark.createDataFrame(v, "run_id int, idx int, seg_id int, s int, e int, at int")
    got = {row["seg_id"]: (row["visual_id"], row["match_reason"], row["overlap_seconds"], row["distance_seconds"]) for row in timeline.align(transcript, visual, 15, 20).collect()}
    assert len(got) == len(t)
    for run, seg, ts, te in t:
        if ts is None or te is None:
            continue
        pairs = [(max(0, min(te, ve) - max(ts, vs)), min(vs - te if te < vs else ts - ve if ve < ts else 0, abs((ts + te) / 2 - at)), idx, vid) for vrun, idx, vid, vs, ve, at in v if vrun == run]
        hits, near = [(-o, idx, vid) for o, _, idx, vid in pairs if o > 0], [(d, idx, vid) for _, d, idx, vid in pairs if d <= 15]
        if hits:
            assert got[seg] == (min(hits)[2], "time_overlap", -min(hits)[0], None)
        elif near:
            assert got[seg] == (min(near)[2], "nearest_visual_segment", 0, min(near)[0])
        else:
            assert got[seg] == (None, "unaligned", 0, None)
