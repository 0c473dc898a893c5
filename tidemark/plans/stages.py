"""Queries on what the stages of a run resolve and report: covering keyframes, traces, regions, the transcription's gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import regions, timeline, transcription, visual_runs
from ..sources import options
from . import inputs
from .inputs import SQL


def covering_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyframe that covers each transcript's start, to the millisecond; a keyframe covers each second of its first 20 minutes."""
    spans = F.array(F.struct(F.col("s").cast("double").alias("first"), F.lit(1.0).alias("step"), F.lit(1200).alias("n")))
    keyframes = inputs.visual(spark, sf_dir).select("run_id", F.col("idx").cast("long").alias("place"), F.col("seg_id").alias("id"), F.col("s").cast("double").alias("t"), spans.alias("spans"))
    # a start within a millisecond of a second is that second, one 2 ms away is none
    off = F.when(F.col("seg_id") % 3 == 0, 0.002).otherwise(0.0005)
    wanted = inputs.transcript(spark, sf_dir).select("run_id", "seg_id", (F.col("s") + off).alias("at"))
    return visual_runs.covering(wanted, keyframes)


def state_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the low-content decisions that a later fuller frame settles, 20 of a run; stages keep fewer and fewer frames."""
    seen = inputs.visual(spark, sf_dir).select("run_id", "seg_id", F.col("s").cast("double").alias("t"), "value")
    pairs = timeline.lookahead(seen.withColumnRenamed("t", "s"), within=86_400, context=400.0, fuller=1.0)
    at, later = seen.select("run_id", "seg_id", F.col("t").alias("at")), seen.select("run_id", F.col("seg_id").alias("later_id"), F.col("t").alias("selected"))
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("at", "seg_id"))
    source = F.when(F.col("later_id") % 2 == 0, "candidate_pool").otherwise("keyframes")
    low = pairs.join(at, ["run_id", "seg_id"]).join(later, ["run_id", "later_id"]).select("run_id", number.alias("number"), "at", "selected", source.alias("source"), F.col("selected").alias("matched"))
    sides = F.array_compact(F.array(F.lit("candidates"), *[F.when(F.col("seg_id") % k != 0, F.lit(side)) for side, k in (("initial", 5), ("pre_collapse", 3), ("final", 2))]))
    points = seen.select("run_id", "t", F.explode(sides).alias("side"))
    none = low.select("run_id", "number", "at", "selected", F.array().cast("array<string>").alias("overridden")).where("false")
    groups = seen.where("seg_id % 4 = 0").select("run_id", F.col("seg_id").alias("group_no"), "t", F.col("t").alias("representative"))
    found = visual_runs.trace(visual_runs.trace_windows(low, none, 86_400.0), points, groups, most=20)
    listed = F.array_join(F.transform("pre_collapse_times", lambda t: t.cast("long").cast("string")), ",")
    return found.select("run_id", "k", "window", "window_start", "representative_time", "candidates_presence", "initial_presence", "pre_collapse_presence", "final_presence", F.size("candidates_times").alias("n_candidates"), listed.alias("pre_collapse_times"), "group_no", "cause", "n_all", "truncated")


def comparison_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of frames of all sizes: centered, manual by four bounds, unknown; what can't be resolved is the full frame."""
    key = F.col("p_partkey")
    part = inputs.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).cast("int").alias("width"), (F.col("p_size") * 9).cast("int").alias("height"), F.get(F.array(*map(F.lit, ("full", "Center-Crop", "manual", "odd"))), (key % 4).cast("int")).alias("mode"))
    bound = lambda k: (key % k) / (k - 1)
    right = F.when(key % 5 != 0, 1 - bound(6) / 2)
    r = regions.region(F.col("width"), F.col("height"), F.col("mode"), bound(12) * 1.25, bound(9), bound(8) / 2, right, F.lit(1.0))
    return part.withColumn("r", r).select("p_partkey", *[F.col(f"r.{name}").alias(f"{name}_at") for name in ("left", "top", "right", "bottom")], F.col("r.mode").alias("mode"), F.col("r.status").alias("status"))


def transcription_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a run: its line items are segments, its columns say which artifacts there are."""
    key = F.col("o_orderkey")
    orders = inputs.table(spark, sf_dir, "orders")
    runs = orders.select(
        key.alias("run_id"), (key % 11 == 0).alias("has_transcript"), (key % 7 != 0).alias("has_download_report"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("download_status"),
        F.col("o_orderpriority").alias("video_path"), F.when(key % 5 != 0, key.cast("string")).alias("found_video"), F.when(key % 3 != 0, True).alias("has_subtitle_report"), (key % 2 == 0).alias("fallback_required"),
    )
    segments = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("language"))
    done = transcription.reports(transcription.gate(runs, options.transcription({})), segments)
    return done.select("run_id", "status", F.coalesce("error_type", "skip_reason").alias("why"), "video_path", "detected_language", "segment_count")


QUERIES = {f.__name__: f for f in (covering_keyframe, state_trace, comparison_regions, transcription_gates)}

ORACLE_SQL = {
    "covering_keyframe": f"""WITH {SQL}, w AS (SELECT run_id, seg_id, s + CASE WHEN seg_id % 3 = 0 THEN 0.002 ELSE 0.0005 END AS at FROM tr),
f AS (SELECT w.run_id, w.seg_id, arg_min(v.seg_id, v.idx) AS keyframe FROM w JOIN vi v ON v.run_id = w.run_id AND floor(w.at) BETWEEN v.s AND v.s + 1199 AND w.at - floor(w.at) < 0.001 GROUP BY w.run_id, w.seg_id)
SELECT w.run_id, w.seg_id, f.keyframe FROM w LEFT JOIN f ON f.run_id = w.run_id AND f.seg_id = w.seg_id""",
    "state_trace": f"""WITH {SQL},
p AS (SELECT a.run_id, a.seg_id, a.s AS t0, b.seg_id AS later_id, b.s AS selected, row_number() OVER (PARTITION BY a.run_id, a.seg_id ORDER BY b.value DESC, b.s, b.seg_id) AS r
      FROM vi a JOIN vi b ON a.run_id = b.run_id AND b.s > a.s AND b.s - a.s <= 86400 AND b.value - a.value BETWEEN 1.0 AND 400.0),
l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t0, seg_id) AS k, count(*) OVER (PARTITION BY run_id) AS n_all FROM p WHERE r = 1),
h AS (SELECT l.run_id, l.k, bool_or(TRUE) AS candidates, bool_or(v.seg_id % 5 <> 0) AS initial, bool_or(v.seg_id % 3 <> 0) AS pre, bool_or(v.seg_id % 2 <> 0) AS final, min(CASE WHEN v.seg_id % 4 = 0 THEN v.seg_id END) AS group_no
      FROM l JOIN vi v ON v.run_id = l.run_id AND v.s = l.selected GROUP BY l.run_id, l.k),
c AS (SELECT l.run_id, l.k, least(30, count(*)) AS n_candidates FROM l JOIN vi v ON v.run_id = l.run_id AND v.s BETWEEN l.t0 AND l.t0 + 86400 GROUP BY l.run_id, l.k),
t AS (SELECT l.run_id, l.k, v.s, row_number() OVER (PARTITION BY l.run_id, l.k ORDER BY v.s) AS r FROM l JOIN vi v ON v.run_id = l.run_id AND v.s BETWEEN l.t0 AND l.t0 + 86400 WHERE v.seg_id % 3 <> 0),
g AS (SELECT run_id, k, string_agg(CAST(s AS VARCHAR), ',' ORDER BY r) AS times FROM t WHERE r <= 30 GROUP BY run_id, k)
SELECT l.run_id, CAST(l.k AS INTEGER) AS k, 'auto_low_content_' || lpad(CAST(l.k AS VARCHAR), 3, '0') AS "window", CAST(l.t0 AS DOUBLE) AS window_start, CAST(l.selected AS DOUBLE) AS representative_time,
       h.candidates AS candidates_presence, h.initial AS initial_presence, h.pre AS pre_collapse_presence, h.final AS final_presence, CAST(c.n_candidates AS INTEGER) AS n_candidates, coalesce(g.times, '') AS pre_collapse_times, h.group_no,
       CASE WHEN l.later_id % 2 = 0 THEN 'initial_selection_miss' ELSE 'group_boundary_miss' END AS cause, l.n_all, l.n_all > 20 AS truncated
FROM l JOIN h ON h.run_id = l.run_id AND h.k = l.k JOIN c ON c.run_id = l.run_id AND c.k = l.k LEFT JOIN g ON g.run_id = l.run_id AND g.k = l.k WHERE l.k <= 20""",
    "comparison_regions": """WITH p AS (SELECT p_partkey, CAST(p_size * 16 AS INTEGER) AS w, CAST(p_size * 9 AS INTEGER) AS h, p_partkey % 4 AS m, (p_partkey % 12) / 11.0::DOUBLE * 1.25 AS pct,
  (p_partkey % 9) / 8.0::DOUBLE AS l, (p_partkey % 8) / 7.0::DOUBLE / 2 AS t, CASE WHEN p_partkey % 5 <> 0 THEN 1 - (p_partkey % 6) / 5.0::DOUBLE / 2 END AS r FROM part),
q AS (SELECT *, greatest(1, CAST(round_even(w * pct, 0) AS INTEGER)) AS cw, greatest(1, CAST(round_even(h * pct, 0) AS INTEGER)) AS ch, CAST(round_even(w * l, 0) AS INTEGER) AS x, CAST(round_even(h * t, 0) AS INTEGER) AS y, CAST(round_even(w * r, 0) AS INTEGER) AS x2 FROM p),
k AS (SELECT *, CASE WHEN m = 0 THEN 'full_frame' WHEN m = 1 AND pct > 0 AND pct <= 1 THEN 'center_crop' WHEN m = 2 AND l < r AND t < 1 AND x2 > x AND h > y THEN 'manual' ELSE 'fallback' END AS kind FROM q)
SELECT p_partkey, CASE kind WHEN 'center_crop' THEN (w - cw) // 2 WHEN 'manual' THEN x ELSE 0 END AS left_at, CASE kind WHEN 'center_crop' THEN (h - ch) // 2 WHEN 'manual' THEN y ELSE 0 END AS top_at,
       CASE kind WHEN 'center_crop' THEN (w - cw) // 2 + cw WHEN 'manual' THEN x2 ELSE w END AS right_at, CASE kind WHEN 'center_crop' THEN (h - ch) // 2 + ch ELSE h END AS bottom_at,
       CASE WHEN kind = 'fallback' THEN 'full_frame' ELSE kind END AS mode, CASE kind WHEN 'fallback' THEN 'fallback_full_frame' WHEN 'full_frame' THEN 'full_frame' ELSE 'active' END AS status FROM k""",
    "transcription_gates": """WITH n AS (SELECT l_orderkey, count(*) AS n, max(l_returnflag) AS language FROM lineitem GROUP BY l_orderkey),
g AS (SELECT o_orderkey AS run_id, o_orderpriority, CASE WHEN o_orderkey % 11 = 0 THEN 'raw_transcript_exists' WHEN o_orderkey % 7 = 0 THEN 'MissingDownloadReport' WHEN o_orderstatus <> 'F' THEN 'DownloadFailed'
  WHEN o_orderkey % 3 = 0 THEN 'MissingSubtitleReport' WHEN o_orderkey % 2 <> 0 THEN 'fallback_not_required' WHEN o_orderkey % 5 = 0 THEN 'MissingVideo' WHEN n.n IS NULL THEN 'NoTimedSegments' END AS why, n.n, n.language
  FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey)
SELECT run_id, CASE WHEN why IS NULL THEN 'success' WHEN why IN ('raw_transcript_exists', 'fallback_not_required') THEN 'skipped' ELSE 'failed' END AS status, why,
       CASE WHEN why IN ('raw_transcript_exists', 'MissingDownloadReport') THEN NULL WHEN run_id % 5 <> 0 THEN CAST(run_id AS VARCHAR) ELSE o_orderpriority END AS video_path,
       CASE WHEN why IS NULL THEN language END AS detected_language, CASE WHEN why IS NULL THEN n ELSE 0 END AS segment_count FROM g""",
}
