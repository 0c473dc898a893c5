"""Queries on event timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import timeline
from . import inputs
from .inputs import SQL


def align_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.align(inputs.transcript(spark, sf_dir), inputs.visual(spark, sf_dir), inputs.NEAREST, inputs.LONGEST)


_ALIGN = f"""{SQL},
p AS (SELECT t.run_id, t.seg_id, v.idx, v.seg_id AS visual_id, greatest(0, least(t.e, v.e) - greatest(t.s, v.s)) AS ov,
      least(CASE WHEN t.e < v.s THEN v.s - t.e WHEN v.e < t.s THEN t.s - v.e ELSE 0 END, abs((t.s + t.e) / 2.0 - v.at)) AS d FROM tr t JOIN vi v ON t.run_id = v.run_id),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, seg_id ORDER BY ov DESC, idx) AS k FROM p WHERE ov > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, seg_id ORDER BY d, idx) AS k FROM p WHERE d <= 3600),
al AS (SELECT t.run_id, t.seg_id, coalesce(o.visual_id, n.visual_id) AS visual_id,
       CASE WHEN o.seg_id IS NOT NULL THEN 'time_overlap' WHEN n.seg_id IS NOT NULL THEN 'nearest_visual_segment' ELSE 'unaligned' END AS match_reason,
       CAST(coalesce(o.ov, 0) AS DOUBLE) AS overlap_seconds, CASE WHEN o.seg_id IS NULL THEN CAST(n.d AS DOUBLE) END AS distance_seconds,
       CASE WHEN o.ov >= 0.5 * (t.e - t.s) THEN 'high' WHEN o.seg_id IS NOT NULL THEN 'medium' WHEN n.seg_id IS NOT NULL THEN 'low' ELSE 'none' END AS confidence
       FROM tr t LEFT JOIN o ON o.run_id = t.run_id AND o.seg_id = t.seg_id AND o.k = 1 LEFT JOIN n ON n.run_id = t.run_id AND n.seg_id = t.seg_id AND n.k = 1)
"""


def align_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_best_overlap(spark, sf_dir)
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("confidence") == "none").alias("n_unaligned"), F.count_if(F.col("confidence") == "low").alias("n_low"), F.count_if(F.col("confidence") == "high").alias("n_high"))


def timeline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.coverage(inputs.transcript(spark, sf_dir), inputs.visual(spark, sf_dir))


def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline.gaps(inputs.transcript(spark, sf_dir)).withColumn("side", F.lit("transcript"))
    return t.unionByName(timeline.gaps(inputs.visual(spark, sf_dir)).withColumn("side", F.lit("visual")))


def visual_segments_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.visual(spark, sf_dir).select("run_id", F.col("idx").cast("long").alias("idx"), "seg_id", F.col("s").alias("start_s"), F.col("e").alias("end_s"))


def covered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyframe that covers a transcript's minute, and how many keyframes (30 at most) lie within a day of it."""
    keys = inputs.visual(spark, sf_dir).select("run_id", "idx", F.col("s").alias("ks"), F.explode(F.sequence(F.col("s") - F.col("s") % 60, F.col("s") - F.col("s") % 60 + 3540, F.lit(60))).alias("minute"))
    wanted = inputs.transcript(spark, sf_dir).select("run_id", "seg_id", "s", (F.col("s") - F.col("s") % 60).alias("minute"))
    first = wanted.join(keys, ["run_id", "minute"]).groupBy("run_id", "seg_id").agg(F.min("idx").cast("long").alias("first_idx"))
    day = 86_400
    spread = inputs.visual(spark, sf_dir).select("run_id", F.col("s").alias("ks"), F.explode(F.sequence(F.floor(F.col("s") / day) - 1, F.floor(F.col("s") / day) + 1)).alias("bucket"))
    near = wanted.withColumn("bucket", F.floor(F.col("s") / day)).join(spread, ["run_id", "bucket"]).where(F.abs(F.col("ks") - F.col("s")) <= day)
    near = near.groupBy("run_id", "seg_id").agg(F.least(F.count(F.lit(1)), F.lit(30)).alias("n_window"))
    return wanted.select("run_id", "seg_id").join(first, ["run_id", "seg_id"], "left").join(near, ["run_id", "seg_id"], "left").select("run_id", "seg_id", "first_idx", F.coalesce("n_window", F.lit(0)).alias("n_window"))


def lookahead_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.lookahead(inputs.visual(spark, sf_dir).select("run_id", "seg_id", "s", "value"), within=5 * 86_400, context=400.0, fuller=1.0)


def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.events(spark, sf_dir)
    return rows.groupBy("run_id").agg(F.max_by("seg_id", F.struct("s", "seg_id")).alias("seg_id"), F.max("s").alias("latest_s"))


def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame times every 12 hours over each run's span."""
    span = inputs.events(spark, sf_dir).groupBy("run_id").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return span.select("run_id", F.posexplode(F.sequence(F.col("low"), F.col("high"), F.lit(43_200))).alias("k", "at_s")).select("run_id", (F.col("k") + 1).cast("long").alias("frame_no"), "at_s")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a run in the order of their first occurrence."""
    rows = inputs.events(spark, sf_dir).groupBy("run_id", "event_type").agg(F.min(F.struct("s", "seg_id")).alias("first"))
    held = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("l"))
    return held.select("run_id", F.array_join(F.transform("l", lambda x: x["event_type"]), ",").alias("event_types"))


def distinct_on_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents that share language and text, the first; a map-side minimum instead of a window over hot groups."""
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.groupBy("lang", F.sha2("text", 256).alias("text_sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_same"))


def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as T

    within = F.col("s") % 86_400
    clock = T.format_timestamp(within)
    rows = inputs.events(spark, sf_dir).select("seg_id", clock.alias("clock"), T.time_token(within + (F.col("seg_id") % 8) / 8).alias("token"))
    return rows.withColumn("parsed", T.parse_timestamp(F.concat(F.col("clock"), F.lit(",500"))))


def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "events")
    held = F.from_json("props", "map<string,string>")
    return rows.select("event_id", F.cardinality(held).cast("long").alias("n_props"), F.array_join(F.array_sort(F.map_keys(held)), "+").alias("keys"))


def review_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by what calls for review: no visual, many visuals, or a non-monotonic value, with their counts."""
    rows = inputs.events(spark, sf_dir)
    order = Window.partitionBy("run_id").orderBy("s", "seg_id")
    marked = rows.withColumn("falls", F.col("value") < F.lag("value").over(order))
    runs = marked.groupBy("run_id").agg(F.count_if(F.col("event_type") == "view").alias("n_visual"), F.count(F.lit(1)).alias("n_rows"), F.count_if("falls").alias("n_falls"))
    return runs.select("run_id", "n_visual", "n_rows", "n_falls", F.when(F.col("n_visual") == 0, "no_visual").when(F.col("n_visual") * 2 > F.col("n_rows"), "many_visuals").when(F.col("n_falls") == 0, "monotonic").otherwise("ok").alias("bucket"))


QUERIES = {f.__name__: f for f in (align_best_overlap, align_status_counts, timeline_coverage, gap_summary, visual_segments_lead, covered_lookup, lookahead_pairs, latest_artifact, frame_grid, ordered_distinct, distinct_on_path, time_format, json_projection, review_buckets)}

ORACLE_SQL = {
    "align_best_overlap": f"WITH {_ALIGN} SELECT * FROM al",
    "align_status_counts": f"WITH {_ALIGN} SELECT run_id, count(*) AS n_rows, count(*) FILTER (WHERE confidence = 'none') AS n_unaligned, count(*) FILTER (WHERE confidence = 'low') AS n_low, count(*) FILTER (WHERE confidence = 'high') AS n_high FROM al GROUP BY run_id",
    "timeline_coverage": f"""WITH {SQL}, t AS (SELECT run_id, min(s) AS transcript_start, max(e) AS transcript_end FROM tr GROUP BY run_id), v AS (SELECT run_id, min(s) AS visual_start, max(e) AS visual_end FROM vi GROUP BY run_id)
SELECT t.run_id, transcript_start, transcript_end, visual_start, visual_end, greatest(0, transcript_end - transcript_start) AS transcript_duration,
CASE WHEN visual_end IS NOT NULL THEN greatest(0, visual_end - visual_start) END AS visual_duration,
CASE WHEN visual_end IS NOT NULL AND transcript_end > transcript_start THEN round(greatest(0, visual_end - visual_start) / CAST(transcript_end - transcript_start AS DOUBLE), 6) END AS duration_ratio FROM t LEFT JOIN v ON t.run_id = v.run_id""",
    "gap_summary": f"""WITH {SQL}, g AS (SELECT run_id, 'transcript' AS side, s - lag(e) OVER (PARTITION BY run_id ORDER BY s, seg_id) AS gap FROM tr UNION ALL SELECT run_id, 'visual', s - lag(e) OVER (PARTITION BY run_id ORDER BY s, seg_id) FROM vi)
SELECT run_id, side, count(*) FILTER (WHERE gap > 0.001) AS gap_count, CAST(coalesce(max(gap) FILTER (WHERE gap > 0.001), 0) AS DOUBLE) AS max_gap FROM g GROUP BY run_id, side""",
    "visual_segments_lead": f"WITH {SQL} SELECT run_id, CAST(idx AS BIGINT) AS idx, seg_id, s AS start_s, e AS end_s FROM vi",
    "covered_lookup": f"""WITH {SQL}, a AS (SELECT t.run_id, t.seg_id, min(v.idx) FILTER (WHERE (t.s - t.s % 60) BETWEEN (v.s - v.s % 60) AND (v.s - v.s % 60) + 3540) AS first_idx, count(v.idx) FILTER (WHERE abs(v.s - t.s) <= 86400) AS n FROM tr t LEFT JOIN vi v ON t.run_id = v.run_id GROUP BY t.run_id, t.seg_id)
SELECT run_id, seg_id, CAST(first_idx AS BIGINT) AS first_idx, CAST(least(n, 30) AS BIGINT) AS n_window FROM a""",
    "lookahead_pairs": f"""WITH {SQL}, p AS (SELECT a.run_id, a.seg_id, b.seg_id AS later_id, row_number() OVER (PARTITION BY a.run_id, a.seg_id ORDER BY b.value DESC, b.s, b.seg_id) AS k, count(*) OVER (PARTITION BY a.run_id, a.seg_id) AS n_fuller FROM vi a JOIN vi b ON a.run_id = b.run_id AND b.s > a.s AND b.s - a.s <= 432000 WHERE b.value - a.value >= 1.0 AND b.value - a.value <= 400.0)
SELECT run_id, seg_id, n_fuller, later_id FROM p WHERE k = 1""",
    "latest_artifact": f"WITH {SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, seg_id DESC) AS k FROM ev) SELECT run_id, seg_id, s AS latest_s FROM o WHERE k = 1",
    "frame_grid": f"WITH {SQL}, b AS (SELECT run_id, min(s) AS low, max(s) AS high FROM ev GROUP BY run_id), g AS (SELECT run_id, low, unnest(generate_series(0, (high - low) // 43200)) AS k FROM b) SELECT run_id, CAST(k + 1 AS BIGINT) AS frame_no, low + 43200 * k AS at_s FROM g",
    "ordered_distinct": f"WITH {SQL}, f AS (SELECT run_id, event_type, min(s * 100000000 + seg_id) AS first FROM ev GROUP BY run_id, event_type) SELECT run_id, string_agg(event_type, ',' ORDER BY first) AS event_types FROM f GROUP BY run_id",
    "distinct_on_path": "SELECT lang, sha256(text) AS text_sha, min(doc_id) AS doc_id, count(*) AS n_same FROM documents GROUP BY lang, text",
    "time_format": f"""WITH {SQL}, w AS (SELECT seg_id, s % 86400 AS d FROM ev) SELECT seg_id, format('{{:02d}}:{{:02d}}:{{:02d}}', d // 3600, (d % 3600) // 60, d % 60) AS clock,
lpad(format('{{:.3f}}', d + (seg_id % 8) / 8.0), 10, '0') AS token, d + 0.5 AS parsed FROM w""",
    "json_projection": "SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS n_props, array_to_string(list_sort(json_keys(props)), '+') AS keys FROM events",
    "review_buckets": f"""WITH {SQL}, m AS (SELECT *, value < lag(value) OVER (PARTITION BY run_id ORDER BY s, seg_id) AS falls FROM ev), r AS (SELECT run_id, count(*) FILTER (WHERE event_type = 'view') AS n_visual, count(*) AS n_rows, count(*) FILTER (WHERE falls) AS n_falls FROM m GROUP BY run_id)
SELECT *, CASE WHEN n_visual = 0 THEN 'no_visual' WHEN n_visual * 2 > n_rows THEN 'many_visuals' WHEN n_falls = 0 THEN 'monotonic' ELSE 'ok' END AS bucket FROM r""",
}
