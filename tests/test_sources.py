"""Files, settings, probes and digests of runs."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.functions import coerce
from tidemark.operators import digests
from tidemark.sources import inventory, options, probes


def put(root, *names):
    for k, name in enumerate(names):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * (k + 1))
        os.utime(path, (1000 + k, 1000 + k))


def test_inventory_reads_no_content(spark, tmp_path):
    put(tmp_path, "a/raw/v1.en.vtt", "a/raw/other.en.srt", "a/raw/v1.en.srt", "a/raw/v.mp4", "a/raw/w.webm", "a/raw/z.mp4.part", "b/raw/x.de.vtt", "b/raw/y.en.VTT", "c/audit/raw_transcript.json", "c/assets/keyframes/k1.jpg", "stray.txt")
    files = inventory.listing(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0] and files.count() == 10
    wanted = spark.createDataFrame([("a", "v1", "en"), ("b", "v1", "en"), ("c", "v1", "en")], "run_id string, video_id string, language string")
    got = {r.run_id: r.path and r.path.split("/")[-1] for r in inventory.subtitle_files(files, wanted).collect()}
    assert got == {"a": "v1.en.srt", "b": "y.en.VTT", "c": None}
    there = [r.path for r in files.where("name = 'raw/v.mp4'").collect()]
    reported = spark.createDataFrame([("a", ["", "gone.mp4", *there]), ("b", None), ("c", [])], "run_id string, paths array<string>")
    got = {r.run_id: (r.path and r.path.split("/")[-1], r.source) for r in inventory.video_files(files, reported).collect()}
    assert got["a"] == ("v.mp4", "report") and got["b"] == (None, None)
    assert {r.run_id: r.source for r in inventory.video_files(files, reported.withColumn("paths", F.lit(None).cast("array<string>"))).collect()}["a"] == "newest"
    found, none = inventory.required(inventory.video_files(files, reported), "the video")
    assert sorted(r.run_id for r in found.collect()) == ["a", "c"] and [tuple(r) for r in none.collect()] == [("b", "FileNotFoundError", "the video was not found")]


def test_missing_inputs_and_keyframes(spark, tmp_path):
    put(tmp_path, "a/audit/raw_transcript.json", "a/audit/visual_segments.json", "a/audit/frame_report.json", "a/assets/keyframes/k1.jpg", "b/audit/raw_transcript.json")
    files = inventory.listing(spark, str(tmp_path))
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    assert inventory.missing_inputs(files, runs, inventory.ALIGNMENT_INPUTS).where("run_id = 'a'").count() == 0
    assert sorted(r.input for r in inventory.missing_inputs(files, runs, inventory.ALIGNMENT_INPUTS).collect()) == ["frame_report_path", "keyframe_dir", "visual_segments_path"]
    segments = spark.createDataFrame([("a", 1, "k1.jpg"), ("a", 2, "k2.jpg"), ("b", 1, "k1.jpg")], "run_id string, seg_id long, file string")
    assert sorted(map(tuple, inventory.missing_keyframes(files, segments).collect())) == [("a", 2, "k2.jpg"), ("b", 1, "k1.jpg")]


def test_one_bad_setting_of_a_thousand_runs(spark):
    rows = spark.range(1000).select(F.col("id").alias("run_id"), F.when(F.col("id") == 77, "NaN").otherwise(F.col("id").cast("string")).alias("threshold"), F.lit(" ").alias("enabled"))
    rules = {"threshold": lambda v: coerce.checked_number(v, 1.0, "threshold", least=0), "enabled": lambda v: coerce.checked_boolean(v, None, "enabled")}
    good, bad = coerce.settings(rows, rules)
    assert good.count() == 999 and good.where("enabled IS NOT NULL").count() == 0
    assert [(r.run_id, [tuple(e) for e in r.errors]) for r in bad.collect()] == [(77, [("threshold", "ValueError", "threshold must be a number in range: NaN")])]


def test_digests_go_by_rows_alone(spark):
    rows = spark.createDataFrame([(1, "a", None, [1]), (1, "b", 2.0, None), (1, "b", 2.0, None), (2, "a", None, [1])], "run_id long, s string, x double, l array<int>")
    of = lambda d: sorted(map(tuple, digests.digests(d).collect()))
    assert of(rows) == of(rows.orderBy(F.desc("s")).repartition(3)) and len(of(rows)) == 2
    assert of(rows) != of(rows.dropDuplicates(["run_id", "s"])) and of(rows.limit(0)) == []
    shifted = spark.createDataFrame([(1, None, "a"), (2, "a", None)], "run_id long, a string, b string")
    assert len({r.a for r in digests.digests(shifted).collect()}) == 2  # nulls have places
    sources = digests.sources({"x": rows, "y": rows.where("run_id = 1")})
    assert digests.changed(sources, sources).collect() == []
    now = digests.sources({"x": rows.withColumn("s", F.when(F.col("run_id") == 2, "z").otherwise(F.col("s"))), "y": rows.where("false")})
    assert sorted(map(tuple, digests.changed(sources, now).collect())) == [(1, "y"), (2, "x")]


def test_download_reports(spark):
    bodies = [
        ("ok", '{"requested_formats":[{"format_id":"137","vcodec":"avc","height":1080,"width":1920},{"format_id":140,"vcodec":"none","acodec":"mp4a"}]}', "v.mp4", ["JavaScript runtime missing", "other", "no JS runtime", "no JS runtime"]),
        ("low", '{"format_id":"18","height":360,"width":640,"vcodec":"avc"}', "v.mp4", None),
        ("none", "[1", None, []),
    ]
    found = spark.createDataFrame(bodies, "run_id string, body string, video_path string, messages array<string>")
    probed = spark.createDataFrame([("ok", '{"streams":[{"codec_type":"video","codec_name":"h264","width":"1280","height":720}]}', 0, None), ("low", "", 1, None)], "run_id string, body string, return_code int, message string")
    got = {r.run_id: r for r in jobs.downloads(found, probed, options.acquisition({}))["reports"].collect()}
    r = got["ok"]
    assert (r.status, r.acquisition_status, r.format_id, r.vcodec, r.downloaded_resolution, r.resolution_fallback_used, r.environment_warnings) == ("success", "degraded", "137+140", "h264", "1280x720", True, ["JavaScript runtime missing", "no JS runtime"])
    assert (got["low"].downloaded_resolution, got["low"].acquisition_status, got["low"].environment_warnings) == ("640x360", "degraded", [])
    assert (got["none"].status, got["none"].format_id, got["none"].actual_video_height) == ("failed", None, None)
    assert probes.acquisition(jobs.downloads(found, probed, options.acquisition({}))["reports"]).columns[1:4] == ["status", "requested_preferred_height", "actual_video_width"]


def test_transcriptions(spark):
    runs = spark.createDataFrame([("a", False, True, "success", "v", "v", True, True), ("b", True, True, "success", "v", "v", True, True), ("c", False, True, "success", "v", "v", True, True)], "run_id string, has_transcript boolean, has_download_report boolean, download_status string, video_path string, found_video string, has_subtitle_report boolean, fallback_required boolean")
    segments = spark.createDataFrame([("a", 1, 1.0, 2.0, "y", "en"), ("a", 0, 0.0, 1.0, "x", "en"), ("b", 0, 0.0, 1.0, "z", "en")], "run_id string, pos int, s double, e double, text string, language string")
    got = jobs.transcriptions(runs, segments, options.transcription({}))
    assert {r.run_id: (r.status, r.segment_count) for r in got["reports"].collect()} == {"a": ("success", 2), "b": ("skipped", 0), "c": ("failed", 0)}
    assert sorted((r.run_id, r.name) for r in got["files"].collect()) == [("a", "audit/raw_transcript.json"), ("a", "audit/transcription_report.json"), ("b", "audit/transcription_report.json"), ("c", "audit/transcription_report.json")]


@pytest.mark.parametrize("body", [None, "", "{", "[]", '{"streams": 5}', '{"streams": [null, 1, "video"]}'])
def test_probes_never_fail(spark, body):
    held = spark.createDataFrame([(1, body, None, None)], "run_id long, body string, return_code int, message string")
    r = probes.video_metadata(held).first().video
    assert r.width is None and r.warning == (probes.INVALID if body == "{" else probes.NO_VIDEO)
