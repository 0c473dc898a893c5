"""Options of the visual and transcription stages, regions, the transcription's gates."""

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import folds, gates, regions, transcription, visual_runs
from tidemark.sources import options


def test_visual_options():
    found = options.visual({"max_keyframes": "12", "target_video_height": 720, "comparison_crop_left": "0.25", "ocr_language": " "}, smoke=30)
    assert (found["max_keyframes"], found["target_video_height"], found["smoke_seconds"], found["comparison_crop_left"], found["ocr_language"]) == (12, 720, 30.0, 0.25, None)
    assert len(found) == 63
    assert options.visual({"max_keyframes": 12}, most_keyframes=5)["max_keyframes"] == 5
    assert options.visual({"preferred_video_height": 480, "target_video_height": 720})["target_video_height"] == 480
    for bad in ({"max_keyframes": 0}, {"frame_interval_seconds": "x"}, {"min_sharpness_score": -1}, {"animation_collapse_enabled": "maybe"}):
        with pytest.raises(ValueError):
            options.visual(bad)
    assert options.quality_thresholds(found)["dark_frame_mean_threshold"] == 5.0
    assert options.requested_region(found)["crop_left"] == 0.25
    # the folds' own defaults are those of the options, but for the number of keyframes
    plain = options.visual({})
    assert folds.Collapse.of(plain) == folds.Collapse() and folds.Lookahead.of(plain) == folds.Lookahead()
    assert folds.Selection.of({**plain, "max_keyframes": 1000}) == folds.Selection()


def test_acquisition_options():
    found = options.acquisition({})
    want = "bestvideo[height>=1080]+bestaudio/bestvideo[height>=1080][ext=mp4]+bestaudio[ext=m4a]/best[height>=1080]/bestvideo+bestaudio/best"
    assert found["effective_format_selector"] == want
    strict = options.acquisition({"allow_video_resolution_fallback": "no", "min_video_height": 720})["effective_format_selector"]
    assert strict.endswith("/best[height>=1080]/bestvideo[height>=720]+bestaudio/bestvideo[height>=720][ext=mp4]+bestaudio[ext=m4a]/best[height>=720]")
    assert options.acquisition({"yt_dlp_format": "best"})["effective_format_selector"] == "best"
    with pytest.raises(ValueError):
        options.acquisition({"resolution_fallback_strategy": "other"})


def test_collapse_gives_every_representative_the_lost_times_and_may_not_merge():
    def frame(k, full=0.0):
        return {"id": k, "t": 10.0 * k, "hist": [1.0], "hash": [0] * 8, "title": [0] * 4, "slide": [0] * 4, "content": full, "detail": 0.0, "layout": 0.0, "ok": True, "covered": [10.0 * k]}

    kept, summary = folds.collapse_run([frame(k, k / 10) for k in range(4)], folds.Collapse(keep=2, reset=9))
    assert [(f["id"], f["covered"]) for f in kept] == [(2, [0.0, 10.0, 20.0]), (3, [0.0, 10.0, 30.0])]
    assert summary["n_suppressed"] == 2
    # one full state ends its group; the frames after it may join once more
    frames = [frame(0), frame(1, 1.0), frame(2), frame(3)]
    assert len(folds.collapse(frames, folds.Collapse(merge=False))) == len(folds.collapse(frames, folds.Collapse())) == 2


@pytest.mark.parametrize("settings,want", [
    ({}, (0, 0, 100, 50, "full_frame", "full_frame", False)),
    ({"comparison_region_mode": "center-crop", "comparison_center_crop_percent": 0.5}, (25, 12, 75, 37, "center_crop", "active", False)),
    ({"comparison_region_mode": "center_crop", "comparison_center_crop_percent": 1.5}, (0, 0, 100, 50, "full_frame", "fallback_full_frame", True)),
    ({"comparison_region_mode": "manual", "comparison_crop_left": 0.1, "comparison_crop_top": 0.2, "comparison_crop_right": 0.9, "comparison_crop_bottom": 1}, (10, 10, 90, 50, "manual", "active", False)),
    ({"comparison_region_mode": "manual", "comparison_crop_left": 0.1}, (0, 0, 100, 50, "full_frame", "fallback_full_frame", True)),
    ({"comparison_region_mode": "manual", "comparison_crop_left": 0.9, "comparison_crop_top": 0, "comparison_crop_right": 0.1, "comparison_crop_bottom": 1}, (0, 0, 100, 50, "full_frame", "fallback_full_frame", True)),
    ({"comparison_region_mode": "manual", "comparison_crop_left": 0.5, "comparison_crop_top": 0, "comparison_crop_right": 0.501, "comparison_crop_bottom": 1}, (0, 0, 100, 50, "full_frame", "fallback_full_frame", True)),
    ({"comparison_region_mode": "odd"}, (0, 0, 100, 50, "full_frame", "fallback_full_frame", True)),
])
def test_regions(spark, settings, want):
    r = spark.range(1).select(regions.of_options(F.lit(100), F.lit(50), options.visual(settings)).alias("r")).first().r
    assert (*r[:6], r.warning is not None) == want


def test_crops(spark):
    px = F.array(*[F.lit(k) for k in range(12)])  # 4 by 3
    box = [F.lit(k) for k in (1, 1, 3, 3)]
    r = spark.range(1).select(regions.crop(px, F.lit(4), *box).alias("a"), regions.relative_crop(px, F.lit(4), F.lit(3), 0.0, 0.0, 1.5, 0.4).alias("b"), regions.crop(px, F.lit(4), *[F.lit(k) for k in (2, 2, 2, 2)]).alias("c")).first()
    assert (r.a, r.b, r.c) == ([5, 6, 9, 10], [0, 1, 2, 3], [])


RUNS = "run_id string, has_transcript boolean, has_download_report boolean, download_status string, video_path string, found_video string, has_subtitle_report boolean, fallback_required boolean"


def test_transcription_gates(spark):
    rows = [
        ("done", True, True, "success", "v", "v", True, True),
        ("nodownload", None, None, None, None, None, None, None),
        ("failed", False, True, "failed", "v", None, True, True),
        ("nosubtitles", False, True, "success", "v", "v", False, None),
        ("subtitles", False, True, "success", "v", "v", True, False),
        ("novideo", False, True, "success", "v", None, True, True),
        ("silent", False, True, "success", "v", "w", True, True),
        ("ready", False, True, "success", "v", "w", True, True),
    ]
    runs = spark.createDataFrame(rows, RUNS)
    segments = spark.createDataFrame([("ready", "en"), ("ready", "en"), ("done", "en")], "run_id string, language string")
    done = transcription.reports(transcription.gate(runs, options.transcription({})), segments)
    got = {r.run_id: (r.status, r.error_type or r.skip_reason, r.video_path, r.segment_count) for r in done.collect()}
    assert got == {
        "done": ("skipped", "raw_transcript_exists", None, 0),
        "nodownload": ("failed", "MissingDownloadReport", None, 0),
        "failed": ("failed", "DownloadFailed", "v", 0),
        "nosubtitles": ("failed", "MissingSubtitleReport", "v", 0),
        "subtitles": ("skipped", "fallback_not_required", "v", 0),
        "novideo": ("failed", "MissingVideo", "v", 0),
        "silent": ("failed", "NoTimedSegments", "w", 0),
        "ready": ("success", None, "w", 2),
    }
    head = transcription.transcripts(done).collect()
    assert [(r.run_id, r.source.type, r.source.language, r.segment_count) for r in head] == [("ready", "faster_whisper_fallback", "en", 2)]
    smoke = transcription.reports(transcription.gate(runs, options.transcription({}, smoke=5), forced=True), segments)
    assert {r.run_id: r.status for r in smoke.collect() if r.status.endswith("success")} == {"done": "smoke_success", "ready": "smoke_success"}
    other = transcription.gate(runs, options.transcription({"transcription_backend": "other"}))
    assert {r.error_type for r in other.where("run_id = 'ready'").collect()} == {"UnsupportedBackend"}
    chosen = spark.createDataFrame([("a", "automatic", "en", "a.vtt"), ("b", "manual", "de", "b.vtt")], "run_id string, source string, language string, subtitle_path string")
    heads = transcription.subtitle_transcripts(chosen, spark.createDataFrame([("a", 1)], "run_id string, seg_id long")).orderBy("run_id").collect()
    assert [(r.source.type, r.source.is_auto_generated, r.segment_count) for r in heads] == [("automatic_subtitle", True, 1), ("platform_subtitle", False, 0)]


def test_covering_keyframe_is_the_first_within_a_millisecond(spark):
    keyframes = spark.createDataFrame([("a", 1, 11, 5.0, [5.0, 7.5]), ("a", 2, 12, 9.0, [7.5, 9.0]), ("b", 1, 13, 2.0, None)], "run_id string, place long, id long, t double, covered array<double>")
    wanted = spark.createDataFrame([("a", 1, 7.5009), ("a", 2, 7.502), ("a", 3, 9.0), ("b", 4, 5.0), ("b", 5, 1.9995)], "run_id string, seg_id long, at double")
    assert {r.seg_id: r.keyframe for r in visual_runs.covering(wanted, keyframes).collect()} == {1: 11, 2: None, 3: 12, 4: None, 5: 13}


def test_spans_cover_what_their_times_cover(spark):
    spans = [("a", 1, 11, 5.0, [(1790.0, 10.0, 4)]), ("a", 2, 12, 9.0, [(1799.9995, 0.0, 1), (3000.5, 0.5, 3000)]), ("a", 3, 13, 1.0, [(0.0, 1.0, 0)]), ("b", 4, 14, 2.0, None), ("a", 5, 15, 7.0, [(1790.0, 10.0, 4)])]
    kinds = "run_id string, place long, id long, t double"
    listed = [(*row, [first + k * step for first, step, n in of or [] for k in range(n)]) for *row, of in spans]
    times = [2.0, 5.0, 9.0005, 1789.9995, 1795.0, 1800.0, 1800.0004, 1820.0, 1830.0, 3000.5, 3001.2, 3001.5009, 4500.0, 4500.002, 4500.5, 4501.0]
    wanted = spark.createDataFrame([(run, k, t) for run in "ab" for k, t in enumerate(times)], "run_id string, seg_id long, at double")
    got = visual_runs.covering(wanted, spark.createDataFrame(spans, f"{kinds}, spans array<struct<first:double,step:double,n:int>>"))
    want = visual_runs.covering(wanted, spark.createDataFrame(listed, f"{kinds}, covered array<double>"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_trace(spark):
    low = spark.createDataFrame([("a", 1, 10.0, 40.0, "candidate_pool", 40.0), ("a", 2, 300.0, None, None, None), ("a", 3, 500.0, 520.0, "covered_candidate", 515.0)], "run_id string, number long, at double, selected double, source string, matched double")
    bounds = spark.createDataFrame([("a", 1, 500.0, 520.0, ["gap"]), ("a", 2, 520.0, 600.0, [])], "run_id string, number long, at double, selected double, overridden array<string>")
    times = {"candidates": [10.0, 40.0, 300.0, 500.0, 515.0, 520.0], "initial": [10.0, 300.0, 500.0], "pre_collapse": [10.0, 300.0, 500.0, 520.0], "final": [40.0, 300.0, 500.0]}
    points = spark.createDataFrame([("a", side, t) for side, ts in times.items() for t in ts], "run_id string, side string, t double")
    groups = spark.createDataFrame([("a", 1, 500.0, 500.0), ("a", 1, 520.0, 500.0)], "run_id string, group_no long, t double, representative double")
    windows = visual_runs.trace_windows(low, bounds, 180.0)
    rows = visual_runs.trace(windows, points, groups).orderBy("k").collect()
    assert [r.window for r in rows] == ["auto_low_content_001", "auto_low_content_002", "auto_low_content_003", "auto_boundary_override_001"]
    assert [(r.candidates_presence, r.initial_presence, r.pre_collapse_presence, r.final_presence) for r in rows] == [(True, False, False, True), (False,) * 4, (True, False, True, True), (True, False, True, True)]
    assert [r.cause for r in rows] == ["initial_selection_miss", "human_review_ambiguity", "group_boundary_miss", "group_boundary_miss"]
    assert (rows[0].candidates_times, rows[0].initial_times, rows[3].pre_collapse_times) == ([10.0, 40.0], [10.0], [500.0, 520.0])
    assert (rows[2].group_no, rows[2].representative_time, rows[2].covering_representative_time) == (1, 500.0, 500.0)
    assert (rows[1].representative_time, rows[1].sampling_miss, rows[0].covering_representative_time) == (None, True, None)
    short = visual_runs.trace(windows, points, groups, most=2).collect()
    assert len(short) == 2 and all(r.n_all == 4 and r.truncated for r in short)


def test_visual_report(spark):
    rows = [("a", k, 10.0 * k, d) for k, d in enumerate(["first_accepted_frame", "quality_rejected", "duplicate_suppressed", "duplicate_fuller_state_update", "visual_difference_threshold"])]
    counts = visual_runs.selection_counts(spark.createDataFrame(rows, "run_id string, id long, t double, decision string"), most=2)
    r = counts.first()
    assert (r.scanned_frame_count, r.valid_frame_count, r.duplicate_suppressed_count, r.stable_segment_count, r.max_keyframes_reached) == (5, 4, 2, 2, True)
    assert ([x.id for x in r.update_samples], [x.id for x in r.rejected_samples]) == ([3], [1])
    bounds = visual_runs.boundary_counts(spark.createDataFrame([("a", ["gap", "title"]), ("a", ["gap"]), ("a", [])], "run_id string, reasons array<string>"))
    b = bounds.first()
    assert (b.join_count, b.break_count, b.break_reasons) == (1, 2, {"gap": 2, "title": 1})
    runs = spark.createDataFrame([("a", "v", False, None, ["x", "b", "x", None]), ("b", None, True, "MissingVideo", None)], "run_id string, video_path string, smoke_test boolean, error_type string, warnings array<string>")
    held = visual_runs.report(runs, [counts, bounds], options.visual({}))
    got = {r.run_id: r for r in held.collect()}
    assert (got["a"].status, got["a"].warnings, got["a"].join_count) == ("success", ["b", "x"], 1)
    assert (got["b"].status, got["b"].stable_segment_count, got["b"].thresholds.min_sharpness_score) == ("failed", 0, 1.5)
    documents = visual_runs.segment_documents(held, spark.createDataFrame([("a", 5.0, 9.0, "k2"), ("a", 0.0, 5.0, "k1"), ("b", 0.0, 1.0, "k")], "run_id string, s double, e double, keyframe string"))
    assert {r.run_id: ([x.keyframe for x in r.segments], r.segment_count) for r in documents.collect()} == {"a": (["k1", "k2"], 2), "b": ([], 0)}
    files = visual_runs.keyframe_files(spark.createDataFrame([("a", 8, 12.5), ("a", 9, 3.25)], "run_id string, id long, t double"))
    assert [r.file for r in files.orderBy("number").collect()] == ["keyframe_0001_t000003.250.jpg", "keyframe_0002_t000012.500.jpg"]


def test_changed_sources(spark):
    make = lambda rows: visual_runs.source_hashes(spark.createDataFrame(rows, "run_id string, name string, content binary"))
    before = make([("a", "x", b"1"), ("a", "y", b"2"), ("b", "x", b"3")])
    assert visual_runs.changed_sources(before, before).collect() == []
    found = visual_runs.changed_sources(before, make([("a", "x", b"1"), ("a", "y", b"9"), ("b", "z", b"3")])).collect()
    assert sorted(map(tuple, found)) == [("a", "y"), ("b", "x"), ("b", "z")]


FRAMES = "run_id string, id long, t double, hist array<double>, hash array<int>, title array<int>, slide array<int>, content double, detail double, layout double, ok boolean"


def test_visual_job(spark, tmp_path):
    def frame(run, k, t, kind, full, ok=True):
        bits = [int(kind >> b & 1) for b in range(8)] * 2
        return (run, k, t, [float(kind == b) for b in range(8)], bits, bits[:4], bits, full, full, full, ok)

    rows = [frame("a", 1, 0.0, 1, 0.05), frame("a", 2, 10.0, 1, 0.05, ok=False), frame("a", 3, 30.0, 1, 0.6), frame("a", 4, 60.0, 6, 0.5), frame("a", 5, 200.0, 6, 0.5), frame("b", 6, 0.0, 1, 0.5, ok=False), frame("c", 7, 0.0, 1, 0.5)]
    runs = spark.createDataFrame([("a", "v", False, 240.0, None, None), ("b", "v", False, 9.0, None, ["w"]), ("c", None, False, None, "MissingVideo", None)], "run_id string, video_path string, smoke_test boolean, duration double, error_type string, warnings array<string>")
    got = jobs.visual(runs, spark.createDataFrame(rows, FRAMES), options.visual({}), str(tmp_path))
    assert [(r.id, r.covered, r.number) for r in got["keyframes"].orderBy("t").collect()] == [(3, [0.0, 30.0], 1), (4, [60.0, 200.0], 2)]
    assert [(r.s, r.e) for r in got["segments"].orderBy("s").collect()] == [(30.0, 60.0), (60.0, 240.0)]
    held = {r.run_id: r for r in got["reports"].collect()}
    assert {k: (r.status, r.error_type, r.frame_count, r.keyframe_count, r.quality_rejected_count) for k, r in held.items()} == {"a": ("success", None, 5, 2, 1), "b": ("failed", "NoKeyframes", 1, 0, 1), "c": ("failed", "MissingVideo", 1, 0, 0)}
    assert {r.run_id: r.segment_count for r in got["documents"].collect()} == {"a": 2, "b": 0, "c": 0}
    assert got["trace"].count() == 0 and [(r["pass"], r.reasons != []) for r in got["boundaries"].orderBy("number").collect()] == [("grouping", True), ("merge", True)]


def test_content_map_job(spark):
    """Four visual segments ten seconds apart, two transcript rows each, from the gates to the outline; a run whose transcript ids repeat is refused."""
    t, v, f = [], [], []
    for run in ("good", "twice"):
        for i in range(4):
            t += [(run, 2 * i + o, 1 if run == "twice" else 2 * i + o + 1, 10.0 * i + 5 * o, 10.0 * i + 5 * o + 4, f"Excerpt {i} {o}") for o in range(2)]
            v.append((run, i, i + 1, 10.0 * i, 10.0 * i + 10, f"k{i}.jpg"))
            f.append((run, i + 1, 10.0 * i, [1.0, 0.0], [1, 0], 0.5 + i / 100, 0.1))
    runs = spark.createDataFrame([("good", "success", False), ("twice", "success", False)], "run_id string, status string, smoke_test boolean")
    transcript = spark.createDataFrame(t, "run_id string, pos long, id long, s double, e double, text string")
    visual = spark.createDataFrame(v, "run_id string, pos long, id long, s double, e double, keyframe_path string")
    features = spark.createDataFrame(f, "run_id string, seg_id long, t double, hist array<double>, hash array<int>, content double, detail double")
    aligned, reports = gates.align_runs(runs, transcript, visual)
    r = reports.where("run_id = 'good'").first()
    assert (r.transcript_count, r.visual_count, r.coverage.end_ratio, r.gap_summary.transcript_gap_count, r.gap_summary.largest_transcript_gap, r.warnings) == (8, 4, round(40 / 39, 6), 7, 1.0, [])
    got = jobs.content_maps(aligned, reports, transcript, visual, features, options.content_map({"content_unit_min_transcript_chars": 20}))
    units = got["units"].collect()
    assert [(u.run_id, u.unit_no, u.selected, len(u.dropped), u.points) for u in units] == [("good", 1, 4, 3, ["too_many_candidates", "visual_change_little_text"])]
    assert [(r.run_id, r.error_type) for r in got["errors"].collect()] == [("twice", "DuplicateTranscriptSegment")]
    assert got["requests"].count() == 1 and got["prompt_packs"].first().item_count == 1 and got["summaries"].first().dropped_keyframe_count == 3
    assert got["outlines"].first().markdown.startswith("## Topic 001") and "rapid_visual_burst" in got["review_reports"].first().markdown
    with pytest.raises(options.UnsupportedBackend):
        jobs.content_maps(aligned, reports, transcript, visual, features, options.content_map({"content_generation_backend": "other", "llm_api_key_env": "X"}))
