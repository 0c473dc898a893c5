"""Queries on what runs come with: probe documents, files, settings and the digests of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import digests
from ..sources import inventory, probes
from . import inputs

#: What a probe says of an event: a number as text, streams that are no objects, JSON that breaks off, and documents of another kind.
_BODY = """CASE event_type WHEN 'view' THEN concat('{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":', 16 * k, ',"height":"', 9 * k, '"},{"codec_type":"video","width":1}]}')
WHEN 'click' THEN concat('{"streams":[7,{"codec_type":"audio","codec_name":"opus"},{"codec_type":"video","width":"wide","height":', k, ',"codec_name":null}]}') WHEN 'error' THEN concat('{"streams":[', props) WHEN 'signup' THEN '{"streams":{"codec_type":"video"}}' ELSE props END"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select(F.col("event_id").alias("run_id"), F.expr(_BODY).alias("body"), F.expr("CAST(k % 13 = 0 AS int)").alias("return_code"), F.expr("CASE WHEN k % 26 = 0 THEN ' broken pipe ' END").alias("message"))


def probe_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First video and audio stream of each event's probe document."""
    return probes.video_metadata(_probes(spark, sf_dir)).select("run_id", "video.width", "video.height", "video.vcodec", "video.acodec", "video.warning")


def probe_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by resolution and warning."""
    held = probes.video_metadata(_probes(spark, sf_dir)).withColumn("video_path", F.when(F.col("run_id") % 11 > 0, "v.mp4"))
    return probes.video_resolution(held).groupBy("resolution.resolution", "resolution.warning").agg(F.count(F.lit(1)).alias("n"))


def requested_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format ids and the first format with video, of one document an event."""
    rows = inputs.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    body = F.expr("""CASE event_type WHEN 'view' THEN concat('{"format_id":"best","requested_formats":[{"format_id":', k, ',"vcodec":"none"},{"format_id":"', k + 1, '","vcodec":"vp9","height":', 9 * k, '},{"vcodec":"av1"}]}')
WHEN 'click' THEN concat('{"format_id":"', k, '","requested_formats":[],"vcodec":"h264","height":"', k, '"}') WHEN 'error' THEN '[' WHEN 'signup' THEN '{"requested_formats":[{"vcodec":"none"}],"vcodec":"x"}' ELSE props END""")
    held = probes.requested_formats(rows.select(F.col("event_id").alias("run_id"), body.alias("body")))
    return held.select("run_id", "format_id", "format.vcodec", "format.height")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as files of their users' runs."""
    rows = inputs.events(spark, sf_dir)
    language, kind = F.expr("element_at(array('en', 'de', 'fr'), CAST(seg_id % 3 + 1 AS int))"), F.expr("element_at(array('.vtt', '.SRT', '.mp4', '.mp4.part', '.webm'), CAST(seg_id % 5 + 1 AS int))")
    name = F.concat(F.lit("raw/"), F.when(F.col("seg_id") % 2 == 0, F.concat(F.lit("v"), F.col("run_id").cast("string"))).otherwise("other"), F.lit("."), language, F.lit("."), F.col("seg_id").cast("string"), kind)
    path = F.concat(F.lit("runs/"), F.col("run_id").cast("string"), F.lit("/"), F.col("name"))
    held = rows.select("run_id", name.alias("name"), F.timestamp_seconds("s").alias("modified"), F.lit(1).cast("long").alias("length"))
    return inventory.described(held.withColumn("path", path))


def file_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtitle and the video file of each run, by precedence."""
    files = _files(spark, sf_dir)
    runs = files.select("run_id").distinct()
    wanted = runs.select("run_id", F.concat(F.lit("v"), F.col("run_id").cast("string")).alias("video_id"), F.when(F.col("run_id") % 4 == 0, "fr").otherwise("en").alias("language"))
    told = F.array(F.lit(""), F.lit("gone.mp4"), F.concat(F.lit("runs/"), F.col("run_id").cast("string"), F.lit("/raw/other.en."), (F.col("run_id") * 30 + 3).cast("string"), F.lit(".mp4.part")))
    reported = runs.select("run_id", F.when(F.col("run_id") % 2 == 0, told).alias("paths"))
    subtitles = inventory.subtitle_files(files, wanted).withColumnRenamed("path", "subtitle_path")
    return subtitles.join(inventory.video_files(files, reported).withColumnsRenamed({"path": "video_path", "source": "video_source"}), "run_id")


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events name a file that their run's keyframe folder lacks, by run."""
    files = _files(spark, sf_dir).where("suffix = '.mp4'").withColumn("name", F.concat(F.lit("assets/keyframes/"), "file"))
    wanted = _files(spark, sf_dir).where("suffix IN ('.mp4', '.webm')").select("run_id", F.col("length").alias("seg_id"), "file")
    return inventory.missing_keyframes(files, wanted).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_missing"))


RULES = {
    "limit": lambda v: coerce.checked_positive_int(v, 1000, "limit"),
    "threshold": lambda v: coerce.checked_number(v, 0.5, "threshold", least=0),
    "enabled": lambda v: coerce.checked_boolean(v, True, "enabled"),
}


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select(
        F.col("event_id").alias("run_id"),
        F.expr("CASE WHEN k % 7 = 0 THEN NULL WHEN k % 41 = 0 THEN concat(k, '.5') ELSE concat(' ', k % 50, ' ') END").alias("limit"),
        F.expr("CASE WHEN k % 5 = 0 THEN '  ' WHEN k % 37 = 0 THEN '-1.5' ELSE concat(k, '.25') END").alias("threshold"),
        F.expr("element_at(array('yes', 'OFF', '', 'true', '0', 'perhaps'), CAST(CASE WHEN k % 17 = 3 THEN 6 ELSE k % 5 + 1 END AS int))").alias("enabled"),
    )


def settings_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of the runs all of whose settings are good."""
    return coerce.settings(_settings(spark, sf_dir), RULES)[0]


def bad_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bad setting with its error; the other runs go on."""
    errors = coerce.settings(_settings(spark, sf_dir), RULES)[1].select("run_id", F.explode("errors").alias("x"))
    return errors.select("run_id", "x.field", "x.type", "x.message")


def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digest of each user's events."""
    rows = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", "props")
    return digests.digests(rows).select("run_id", "n_rows", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs whose events differ where every 97th has another type."""
    rows = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type")
    now = rows.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, "other").otherwise(F.col("event_type")))
    return digests.changed(digests.sources({"events": rows}), digests.sources({"events": now.repartition(3)}))


QUERIES = {f.__name__: f for f in (probe_streams, probe_resolutions, requested_formats, file_ladder, missing_files, settings_of_runs, bad_settings, table_digests, changed_sources)}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_PROBE = f"""e AS (SELECT *, {_K} AS k FROM events), b AS (SELECT event_id AS run_id, {_BODY} AS body, CAST(k % 13 = 0 AS INTEGER) AS return_code, CASE WHEN k % 26 = 0 THEN 'broken pipe' END AS message FROM e),
v AS (SELECT *, json_valid(body) AS ok, CASE WHEN json_valid(body) AND json_type(body, '$.streams') = 'ARRAY' THEN CAST(json_extract(body, '$.streams') AS JSON[]) ELSE [] END AS s FROM b),
m AS (SELECT *, list_filter(s, lambda x: json_extract_string(x, '$.codec_type') = 'video')[1] AS vi, list_filter(s, lambda x: json_extract_string(x, '$.codec_type') = 'audio')[1] AS au FROM v),
p AS (SELECT run_id, CASE WHEN return_code = 0 THEN TRY_CAST(json_extract_string(vi, '$.width') AS BIGINT) END AS width, CASE WHEN return_code = 0 THEN TRY_CAST(json_extract_string(vi, '$.height') AS BIGINT) END AS height,
CASE WHEN return_code = 0 THEN json_extract_string(vi, '$.codec_name') END AS vcodec, CASE WHEN return_code = 0 THEN json_extract_string(au, '$.codec_name') END AS acodec,
CASE WHEN return_code <> 0 THEN coalesce(message, 'ffprobe failed.') WHEN NOT ok THEN 'ffprobe returned invalid JSON' WHEN vi IS NULL THEN 'ffprobe found no video stream.' END AS warning FROM m)"""
_FILES = """f AS (SELECT user_id AS run_id, event_id AS seg_id, floor(epoch(ts)) AS s, ['en', 'de', 'fr'][event_id % 3 + 1] AS lang, ['.vtt', '.SRT', '.mp4', '.mp4.part', '.webm'][event_id % 5 + 1] AS kind, CASE WHEN event_id % 2 = 0 THEN 'v' || user_id ELSE 'other' END AS stem FROM events),
g AS (SELECT *, stem || '.' || lang || '.' || seg_id || kind AS file, 'runs/' || run_id || '/raw/' || stem || '.' || lang || '.' || seg_id || kind AS path FROM f)"""
_SET = f"""e AS (SELECT event_id AS run_id, {_K} AS k FROM events),
t AS (SELECT run_id, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 41 = 0 THEN k || '.5' ELSE CAST(k % 50 AS VARCHAR) END AS a, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 37 = 0 THEN '-1.5' ELSE k || '.25' END AS b,
nullif(['yes', 'OFF', '', 'true', '0', 'perhaps'][CASE WHEN k % 17 = 3 THEN 6 ELSE k % 5 + 1 END], '') AS c FROM e),
r AS (SELECT *, a IS NOT NULL AND NOT (regexp_full_match(a, '[0-9]+') AND a <> '0') AS bad_a, b IS NOT NULL AND CAST(b AS DOUBLE) < 0 AS bad_b, c IS NOT NULL AND c = 'perhaps' AS bad_c FROM t)"""
_DIGEST = "CAST(sum(CAST(CAST('0x' || substr(m, {0}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"

ORACLE_SQL = {
    "probe_streams": f"WITH {_PROBE} SELECT * FROM p",
    "probe_resolutions": f"""WITH {_PROBE}, q AS (SELECT CASE WHEN run_id % 11 > 0 THEN width || 'x' || height END AS resolution, CASE WHEN run_id % 11 = 0 THEN 'No video path was available.' ELSE warning END AS warning FROM p)
SELECT resolution, warning, count(*) AS n FROM q GROUP BY resolution, warning""",
    "requested_formats": f"""WITH e AS (SELECT *, {_K} AS k FROM events) SELECT event_id AS run_id,
CASE event_type WHEN 'view' THEN k || '+' || (k + 1) WHEN 'click' THEN CAST(k AS VARCHAR) END AS format_id,
CASE event_type WHEN 'view' THEN 'vp9' WHEN 'click' THEN 'h264' WHEN 'signup' THEN 'x' END AS vcodec, CASE event_type WHEN 'view' THEN 9 * k WHEN 'click' THEN k END AS height FROM e""",
    "file_ladder": f"""WITH {_FILES}, r AS (SELECT DISTINCT run_id, CASE WHEN run_id % 4 = 0 THEN 'fr' ELSE 'en' END AS want FROM g),
u AS (SELECT g.run_id, path, row_number() OVER (PARTITION BY g.run_id ORDER BY stem <> 'v' || g.run_id, s DESC, path) AS k FROM g JOIN r ON g.run_id = r.run_id AND lang = want WHERE lower(kind) IN ('.vtt', '.srt')),
w AS (SELECT run_id, path, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, path) AS k FROM g WHERE kind IN ('.mp4', '.webm')),
t AS (SELECT run_id, path FROM g WHERE run_id % 2 = 0 AND path = 'runs/' || run_id || '/raw/other.en.' || (run_id * 30 + 3) || '.mp4.part')
SELECT r.run_id, u.path AS subtitle_path, coalesce(t.path, w.path) AS video_path, CASE WHEN t.path IS NOT NULL THEN 'report' WHEN w.path IS NOT NULL THEN 'newest' END AS video_source
FROM r LEFT JOIN u ON u.run_id = r.run_id AND u.k = 1 LEFT JOIN w ON w.run_id = r.run_id AND w.k = 1 LEFT JOIN t ON t.run_id = r.run_id""",
    "missing_files": f"WITH {_FILES} SELECT run_id, count(*) AS n_missing FROM g WHERE kind = '.webm' GROUP BY run_id",
    "settings_of_runs": f"WITH {_SET} SELECT run_id, CAST(coalesce(a, '1000') AS INTEGER) AS limit, CAST(coalesce(b, '0.5') AS DOUBLE) AS threshold, coalesce(lower(c) IN ('yes', 'true'), TRUE) AS enabled FROM r WHERE NOT (bad_a OR bad_b OR bad_c)",
    "bad_settings": f"""WITH {_SET} SELECT run_id, 'limit' AS field, 'ValueError' AS type, 'limit must be a positive whole number: ' || a AS message FROM r WHERE bad_a
UNION ALL SELECT run_id, 'threshold', 'ValueError', 'threshold must be a number in range: ' || b FROM r WHERE bad_b UNION ALL SELECT run_id, 'enabled', 'ValueError', 'enabled must be a boolean: ' || c FROM r WHERE bad_c""",
    "table_digests": f"""WITH h AS (SELECT user_id AS run_id, md5(concat(octet_length(encode(CAST(event_id AS VARCHAR))), ':', event_id, octet_length(encode(event_type)), ':', event_type, octet_length(encode(props)), ':', props)) AS m FROM events)
SELECT run_id, count(*) AS n_rows, {_DIGEST.format(1)} AS a, {_DIGEST.format(16)} AS b FROM h GROUP BY run_id""",
    "changed_sources": "SELECT DISTINCT user_id AS run_id, 'events' AS source FROM events WHERE event_id % 97 = 0",
}
