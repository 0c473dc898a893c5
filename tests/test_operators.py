"""Operators against plain loops and worked cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.functions import coerce
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import budgets, captions, checks, content_map, folds, reports, timeline
from tidemark.sources import artifacts, config, options, subtitles
from tidemark.streaming import sessions


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_alignment_is_that_of_plain_loops(spark):
    t = [(1, k, s, s + d) for k, (s, d) in enumerate([(0, 10), (8, 4), (100, 5), (500, 20), (60, 0), (31, 2)])]
    v = [(1, 1, 11, 0, 10, 0), (1, 2, 12, 10, 30, 10), (1, 3, 13, 60, 60, 60), (1, 4, 14, 128, 140, 128), (2, 1, 15, 0, 900, 0)]
    got = timeline.align(spark.createDataFrame(t, "run_id long, seg_id long, s long, e long"), spark.createDataFrame(v, "run_id long, idx int, seg_id long, s long, e long, at long"), 30, 50).collect()
    for r in got:
        _, _, s, e = t[r.seg_id]
        best, nearest = (0, None), (31, None)
        for run, _, vid, vs, ve, at in v:
            if run != 1:
                continue
            shared = max(0, min(e, ve) - max(s, vs))
            if shared > best[0]:
                best = (shared, vid)
            gap = max(0, vs - e, s - ve)
            apart = min(gap, abs((s + e) / 2 - at))
            if apart < nearest[0] and apart <= 30:
                nearest = (apart, vid)
        if best[1]:
            assert (r.visual_id, r.match_reason, r.overlap_seconds) == (best[1], "time_overlap", best[0])
            assert r.confidence == ("high" if best[0] >= 0.5 * (e - s) else "medium")
        elif nearest[1]:
            assert (r.visual_id, r.match_reason, r.distance_seconds, r.confidence) == (nearest[1], "nearest_visual_segment", nearest[0], "low")
        else:
            assert (r.visual_id, r.confidence) == (None, "none")
    assert len(got) == len(t)


def test_overlap_of_nothing_is_null(spark):
    r = one(spark, timeline.overlap(F.lit(0), F.lit(9), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("x"))
    assert r.x is None


@pytest.mark.parametrize("text,most,want", [("a\u00a0\u3000b\t c", 10, "a b c"), ("abcdef", 6, "abcdef"), ("abcdefg", 6, "abc..."), ("ab  cdefg", 6, "ab..."), ("abcd", 2, "..."), ("", 0, ""), ("abcd", 0, "...")])
def test_clip(spark, text, most, want):
    assert one(spark, T.clip(F.lit(text), most).alias("x")).x == want


def test_text_functions(spark):
    r = one(spark, T.parse_timestamp(F.lit("01:02:03,5")).alias("a"), T.parse_timestamp(F.lit("02:03.25")).alias("b"), T.parse_timestamp(F.lit("7")).alias("c"), T.format_timestamp(F.lit(3725.9)).alias("d"), T.format_timestamp(F.lit(-3)).alias("e"), T.time_token(F.lit(12.5)).alias("f"), T.strip_markup(F.lit("<c>a &lt;b&gt;</c>  &amp;lt;")).alias("g"), T.contained(F.lit(" A  b"), F.lit("xa B")).alias("h"), T.contained(F.lit(""), F.lit("x")).alias("i"), T.title_hint(F.lit("ab\nabcd"), 3).alias("j"), T.title_hint(F.lit("ab\ncd"), 3).alias("k"), T.title_hint(F.lit("a"), 3).alias("l"))
    assert tuple(r) == (3723.5, 123.25, None, "01:02:05", "00:00:00", "000012.500", "a <b> &lt;", True, False, "abcd", "ab cd", None)


def test_vectors(spark):
    a, b = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0), F.lit(9.0))
    bits = F.array(F.lit(1), F.lit(0))
    r = one(spark, V.histogram_difference(a, b).alias("h"), V.hash_difference(bits, F.array(F.lit(1), F.lit(1)), 0.0).alias("x"), V.hash_difference(bits, F.array(F.lit(1)), 1.0).alias("y"), V.hash_difference(F.array().cast("array<int>"), F.array().cast("array<int>"), 0.0).alias("z"), V.normalized(F.array(F.lit(0), F.lit(0))).alias("n"), V.detail_density(F.array(*[F.lit(v) for v in (0, 50, 50, 50)]), 2, 2).alias("d"), V.fuller_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(7.0)).alias("f"))
    assert (r.h, r.x, r.y, r.z, r.n, r.d, r.f) == (0.5, 0.5, 1.0, 0.0, [0.0, 0.0], 0.5, 1.08)


def test_coercions(spark):
    r = one(spark, coerce.boolean(F.lit(" YES "), False, "x").alias("a"), coerce.boolean(F.lit(""), True, "x").alias("b"), coerce.number(F.lit("1.5"), 0.0, "x", above=0).alias("c"), coerce.number(F.lit(None).cast("string"), 2.0, "x").alias("d"), coerce.positive_int(F.lit("7"), 1, "x").alias("e"), coerce.string_list(F.lit(" a, ,b"), []).alias("f"), coerce.duration(F.lit("-1")).alias("g"), coerce.resolution(F.lit(1), F.lit(None).cast("int")).alias("h"))
    assert tuple(r) == (True, True, 1.5, 2.0, 7, ["a", "b"], None, None)
    for bad in (coerce.boolean(F.lit("maybe"), True, "x"), coerce.number(F.lit("0"), 1.0, "x", above=0), coerce.positive_int(F.lit("1.5"), 1, "x"), coerce.positive_int(F.lit("0"), 1, "x")):
        with pytest.raises(Exception, match="x must be"):
            one(spark, bad.alias("v"))


def test_settings():
    held = config.parse("\ufeffvideo_url: http://x:1\nrun_id: a\n# no\noutput_dir: d\nn: 5\nq: \"none\"\nz: none\nl: ['a', 'b']\nb: TRUE\nn: 6\nbroken: 'x\n")
    assert held == {"video_url": "http://x:1", "run_id": "a", "output_dir": "d", "n": "6", "q": "none", "z": None, "l": ["a", "b"], "b": True, "broken": "x"}
    with pytest.raises(ValueError, match="run_id"):
        config.parse("video_url: a\noutput_dir: b\nrun_id: ''")
    for bad in ("", ".", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            config.run_id(bad)


@pytest.mark.parametrize("path", ["audit/p.jsonl", "./audit/p.jsonl", "audit/sub/../p.jsonl", "audit\\p.jsonl"])
def test_prompt_pack_paths(path):
    assert artifacts.prompt_pack_path("/runs/a", path) == "/runs/a/audit/p.jsonl"


@pytest.mark.parametrize("path", ["../x.jsonl", "audit/../../x.jsonl", "audit/../x.jsonl", "/x.jsonl", "C:\\x.jsonl", "..\\x.jsonl", "audit\\..\\..\\x.jsonl", "audit", "audit/p.json", "audit/\0.jsonl"])
def test_refused_prompt_pack_paths(path):
    with pytest.raises(ValueError):
        artifacts.prompt_pack_path("/runs/a", path)


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.500 align:start\n<c>Hello</c>\n  world\nNote that\n\n00:03.000 --> 00:04.000\n\n", encoding="utf-8")
    (tmp_path / "b.srt").write_bytes("1\r\n00:00:01,000 --> 00:00:02,000\r\nOne 1\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nTwo\r\n3\r\n".encode())
    got = sorted((r.file[-5:], r.number, r.start, r.end, r.text) for r in subtitles.read(spark, str(tmp_path)).collect())
    assert got == [("a.vtt", 1, 1.0, 2.5, "Hello world"), ("b.srt", 1, 1.0, 2.0, "One 1"), ("b.srt", 2, 3.0, 4.0, "Two 3")]


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "t")
    artifacts.write_runs(spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int"), path)
    artifacts.write_runs(spark.createDataFrame([("a", 3)], "run_id string, x int"), path)
    assert sorted((r.run_id, r.x) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]
    (tmp_path / "x.smoke.json").write_text('{\n"n": 1}')
    assert artifacts.read_json(spark, str(tmp_path / "x.smoke.json"), "n int").first().n == 1
    with pytest.raises(Exception, match="smoke"):
        artifacts.read_json(spark, str(tmp_path / "x.smoke.json"), "n int", allow_smoke=False).collect()
    assert artifacts.latest_file(spark, str(tmp_path), "*.json").endswith("x.smoke.json")
    artifacts.write_prompt_pack(spark.createDataFrame([(1, None)], "unit int, text string"), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).first().value == '{"unit":1,"text":null}'
    held = artifacts.with_acquisition(spark.createDataFrame([("a",), ("b",)], "run_id string"), spark.createDataFrame([("a", "success")], "run_id string, status string"))
    assert {r.run_id: r.acquisition and r.acquisition.status for r in held.collect()} == {"a": "success", "b": None}


def test_checks(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 50), (1, 2, 0), (2, 0, 7)], "run long, pos long, x int")
    got = checks.first_violation(rows, "run", "pos", [("large", F.col("x") > 40), ("none", F.col("x") == 0)]).collect()
    assert [(r.run, r.rule, r.pos) for r in got] == [(1, "large", 1)]


def test_redundant_and_rolling(spark):
    kinds = "run_id string, seg_id long, text string"
    texts = ["So, hi", "so, hi everyone", "everyone", "Other", "other  thing", "x", "X"]
    rows = spark.createDataFrame([("r", k, t) for k, t in enumerate(texts)] + [("s", 1, None)], kinds)
    got = captions.without_redundant(rows).where("run_id = 'r'").orderBy("number").collect()
    assert [(r.number, r.text) for r in got] == [(1, "so, hi everyone"), (2, "other  thing")]
    assert [r.text for r in captions.without_redundant(rows).where("run_id = 's'").collect()] == [""]
    shown = ["Okay, let's get started. So, hi", "Okay, let's get started. So, hi\neveryone. My name is Yan", "everyone. My name is Yan", None]
    rows = spark.createDataFrame([("r", k, t) for k, t in enumerate(shown)], kinds)
    assert [r.text for r in captions.rolling(rows).orderBy("seg_id").collect()] == ["Okay, let's get started. So, hi", "everyone. My name is Yan"]


def frame(k, t, kind=0, content=0.5, detail=0.5, layout=0.5, ok=True):
    bits = [(kind >> (i % 4)) & 1 for i in range(16)]
    hist = [0.0] * 4
    hist[kind % 4] = 1.0
    return {"id": k, "t": float(t), "hist": hist, "hash": bits, "title": bits[:4], "slide": bits, "content": content, "detail": detail, "layout": layout, "ok": ok}


def test_keyframes():
    frames = [frame(0, 0, ok=False), frame(1, 10), frame(2, 20), frame(3, 30, content=0.9), frame(4, 35, kind=1), frame(5, 38, kind=1), frame(6, 100, kind=2)]
    accepted, decisions = folds.select_keyframes(frames, folds.Selection())
    assert [d for _, d in decisions] == ["quality_rejected", "first_accepted_frame", "duplicate_suppressed", "duplicate_fuller_state_update", "visual_difference_threshold", "duplicate_suppressed", "visual_difference_threshold"]
    assert [(f["id"], f["covered"]) for f in accepted] == [(3, [10.0, 20.0, 30.0]), (4, [35.0, 38.0]), (6, [100.0])]
    accepted, decisions = folds.select_keyframes(frames, folds.Selection(most=1))
    assert len(accepted) == 1 and len(decisions) == 2


def test_collapse():
    alike = [frame(1, 0, content=0.4), frame(2, 40, content=0.6), frame(3, 80, content=0.5), frame(4, 500), frame(5, 900, kind=3)]
    got = folds.collapse(alike, folds.Collapse())
    assert [([f["id"] for f in g], [f["id"] for f in keep]) for g, keep in got] == [([1, 2, 3], [2]), ([4], [4]), ([5], [5])]
    assert "reset" in folds.break_reasons([frame(1, 0, content=1.0, layout=1.0)], frame(2, 5, content=0.1), folds.Collapse())


def test_low_content():
    early = {**frame(1, 0, content=0.05, detail=0.02, layout=0.1), "covered": [0.0], "why": "a", "updates": 0}
    later = {**frame(2, 60, content=0.8), "covered": [60.0], "why": "a", "updates": 0}
    kept, decisions = folds.suppress_low_content([dict(early), dict(later)], [], folds.Lookahead())
    assert [(f["id"], f["covered"]) for f in kept] == [(2, [0.0, 60.0])] and decisions[0][1] == "group_boundary_miss"
    kept, decisions = folds.suppress_low_content([dict(early)], [frame(9, 100, content=0.7), frame(8, 50, content=0.7, ok=False)], folds.Lookahead())
    assert [f["id"] for f in kept] == [9] and decisions[0][1] == "initial_selection_miss"
    kept, decisions = folds.suppress_low_content([dict(early)], [frame(9, 300, content=0.7)], folds.Lookahead())
    assert [f["id"] for f in kept] == [1] and decisions[0][1] == "kept"


def test_low_content_looks_at_frames_in_reach_alone(monkeypatch):
    seen, plain = [], folds.later_fuller
    monkeypatch.setattr(folds, "later_fuller", lambda early, later, o: plain(early, (seen.append(f) or f for f in later), o))
    pool = [frame(k, 10 * k, kind=k // 4 % 3, content=0.05 if k % 4 < 3 else 0.7, detail=0.02, layout=0.1, ok=k % 7 > 0) for k in range(2000)]
    keys = [{**f, "covered": [f["t"]], "why": "a", "updates": 0} for f in pool if f["id"] % 2 == 0]
    kept, decisions = folds.suppress_low_content(keys, pool, folds.Lookahead())
    # every early state of a group of four has its fuller one, unless that was not ok
    assert {how for _, how, _ in decisions} == {"initial_selection_miss", "kept"} and len(decisions) == 1000
    assert all(found is None or 0 < found["t"] - early["t"] <= 180 for early, _, found in decisions)
    assert len(seen) < 20 * len(decisions)


def test_images():
    burst = [frame(k, 10 * k, content=k / 10) for k in range(4)]
    pair = [frame(10, 500), frame(11, 530)]
    got = folds.image_groups([*burst, *pair, frame(12, 900)])
    assert [(kind, [f["id"] for f in members]) for kind, members in got] == [("rapid_visual_burst", [0, 1, 2, 3]), ("near_duplicate_visual_pair", [10, 11])]
    picked = folds.pick_images([burst[:2], burst[2:], [frame(20, 72, kind=1)], [frame(21, 120, kind=2)], [frame(21, 120, kind=2), frame(22, 160, kind=3)]])
    assert [(f and f["id"], why) for f, why in picked] == [(None, "no_selected_handout_image"), (3, "selected"), (None, "handout_image_density_limit"), (21, "selected"), (None, "handout_image_density_limit")]


def small_run(spark):
    kinds = "run_id string, seg_id long, s double, e double, chars long, text string, visual int, visual_id long"
    rows = []
    for k, (i, o) in enumerate(itertools.product(range(1, 5), range(2)), 1):
        start, text = 10.0 * (i - 1) + 5 * o, f"Grounded transcript excerpt {k} for visual segment {i}."
        rows.append(("run", k, start, start + 4, len(text), text, i, i))
    return spark.createDataFrame(rows, kinds)


def test_content_map_of_the_small_run(spark):
    """Four visual segments ten seconds apart, two transcript rows each: one unit, one group, one burst of four."""
    held = content_map.with_excerpts(content_map.units(small_run(spark), folds.Options()))
    unit = held.first()
    assert held.count() == 1 and (unit.unit_no, unit.s, unit.e, unit.visuals) == (1, 0.0, 39.0, [1, 2, 3, 4])
    assert [x.seg_id for x in unit["items"]] == list(range(1, 9)) and [x.seg_id for x in unit.excerpts] == [1, 5, 8]
    assert unit.summary.startswith("Grounded transcript excerpt 1 for visual segment 1. / Grounded")
    faces = [("run", i, 10.0 * (i - 1), [1.0, 0.0], [1, 0], 0.5 + i / 100, 0.1) for i in range(1, 5)]
    visual = spark.createDataFrame(faces, "run_id string, seg_id long, t double, hist array<double>, hash array<int>, content double, detail double")
    found = content_map.candidates(held, visual.withColumn("id", F.col("seg_id")))
    found = found.withColumn("run_id", F.lit(1).cast("long"))
    image = content_map.select_images(found, spacing=0.0).first()
    assert image.selected == 4 and [d.id for d in image.dropped] == [1, 2, 3] and image.review_required
    assert {d.reason for d in image.dropped} == {"rapid_visual_burst_keep_one_representative"} and set(image.warnings) == {"rapid_visual_burst_review_required"}
    groups = content_map.image_groups(found)
    assert sorted((r.kind, r.id, r.kept) for r in groups.collect()) == [("rapid_visual_burst", i, i == 4) for i in range(1, 5)]
    whole = held.withColumn("run_id", F.lit(1).cast("long")).join(content_map.select_images(found, spacing=0.0), ["run_id", "unit_no"])
    whole = whole.join(content_map.topic_groups(whole), ["run_id", "unit_no"])
    summary = content_map.validation_summary(whole, groups).first()
    assert (summary.content_unit_count, summary.topic_group_count, summary.selected_keyframe_count, summary.dropped_keyframe_count) == (1, 1, 1, 3)
    assert (summary.near_duplicate_image_group_count, summary.review_required_unit_count, summary.units_monotonic_by_time) == (1, 1, True)
    request = content_map.requests(whole, whole=60).first()
    assert request.unit_id == "unit_001" and request.transcript_item_ids == list(range(1, 9)) and request.selected_keyframe == 4
    assert sum(len(x.text) for x in request.transcript_excerpts) <= 60 and len(request.transcript_excerpts) == 2
    assert content_map.pack_descriptor(whole, "p", False).first().item_count == 0 and content_map.pack_descriptor(whole, "p", True).first().item_count == 1
    pointed = content_map.review_points(whole.withColumns({"n_visuals": F.size("visuals"), "n_candidates": F.size("visuals"), "n_selected": F.lit(1)}))
    assert pointed.first().points == ["too_many_candidates"]
    report = content_map.review_report(pointed).first().markdown
    assert "- `unit_001`: `1` - `rapid_visual_burst_keep_one_representative`" in report and "- Units without selected image: `none`" in report


def test_units_that_may_not_merge(spark):
    far = [("r", 1, 0.0, 10.0, 500, "", 1, 1), ("r", 2, 100.0, 110.0, 500, "", 2, 2), ("r", 3, 115.0, 120.0, 10, "", 4, 4)]
    rows = spark.createDataFrame(far, small_run(spark).schema)
    assert [len(u["items"]) for u in content_map.units(rows, folds.Options()).collect()] == [1, 1, 1]


def test_a_used_or_too_early_image_is_dropped_with_its_reason():
    first, again, soon = frame(1, 100, kind=1), frame(1, 100, kind=1), frame(2, 141, kind=2)
    got, _ = folds.handout_images([[first], [again], [soon]])
    assert [u["selected"] for u in got] == [1, None, None]
    assert [d["reason"] for u in got for d in u["dropped"]] == ["keyframe_already_selected_for_previous_unit", "handout_image_density_limit"]


def test_collapse_keeps_the_tail_and_covered_times():
    o = folds.Collapse()
    # falls by less than a reset, by more than the later position gains
    falling = [{**frame(1, 0, content=1.0, detail=1.0, layout=1.0), "covered": [0.0]}, {**frame(2, 10, content=0.85, detail=0.9, layout=0.9), "covered": [10.0, 12.0]}]
    kept, summary = folds.collapse_run(falling, o)
    assert [(f["id"], f["how"], f["covered"]) for f in kept] == [(1, "fullest_of_group", [0.0, 10.0, 12.0]), (2, "tail_guard_preserved", [10.0, 12.0])]
    assert summary["guarded"] and summary["last_before"] == summary["last_after"] == 10.0 and summary["n_suppressed"] == 1
    assert folds.collapse_run([], o)[0] == [] and folds.boundary_reasons(falling, o)[0][1] == []


def test_options_and_backends():
    found = options.content_map({"handout_min_image_spacing_seconds": "0", "generate_content_map": "no", "output_language": " "})
    assert (found["handout_min_image_spacing_seconds"], found["generate_content_map"], found["output_language"], len(found)) == (0.0, False, "zh-CN", 36)
    for wrong in ({"llm_concurrency": 0}, {"llm_max_retries": -1}, {"content_unit_max_gap_seconds": "x"}, {"generate_content_map": "maybe"}, {"handout_max_images_per_unit": 2}, {"handout_near_duplicate_image_policy": "all"}):
        with pytest.raises(ValueError):
            options.content_map(wrong)
    section = options.backend(found).section({"unit_id": "unit_001"})
    assert section["status"] == "skipped" and section["source_unit_id"] == "unit_001" and section["key_points"] == []
    with pytest.raises(options.UnsupportedBackend):
        options.backend({**found, "content_generation_backend": "openai_compatible", "llm_api_key_env": "EXAMPLE_KEY"})
    with pytest.raises(options.MissingKeyVariable):
        options.backend({**found, "content_generation_backend": "local"})
    with pytest.raises(options.NetworkCallsDisabled):
        options.backend({**found, "llm_allow_network_calls": True})
    with pytest.raises(ValueError):
        options.backend({**found, "content_generation_backend_mode": "full"})


def test_chunks_and_budgets(spark):
    spans = [(0, 100), (50, 240), (200, 241), (250, 300), (600, 700), (601, 602), (602, 603), (603, 604), (604, 605)]
    rows = spark.createDataFrame([("r", k, s, e) for k, (s, e) in enumerate(spans)], "run_id string, seg_id long, s long, e long")
    for most in (None, 2):
        want, chunk = [], []
        for s, e in spans:
            if chunk and (e - chunk[0][0] > 240 or len(chunk) == most):
                want.append(chunk)
                chunk = []
            chunk.append((s, e))
        want.append(chunk)
        got = budgets.chunks(rows, ["run_id"], 240, most).orderBy("chunk").collect()
        assert [(r.s, r.e, r.n) for r in got] == [(min(c)[0], max(e for _, e in c), len(c)) for c in want]
    texts = F.array(*[F.lit("abcdefghij")] * 4)
    assert one(spark, budgets.within_budget(texts, 8, 20).alias("x")).x == ["abcde...", "abcde...", "a..."]
    assert one(spark, budgets.within_budget(texts, 100, 21).alias("x")).x == ["abcdefghij", "abcdefghij", "..."]


def test_outline(spark):
    rows = [("r", 1, 1, 0.0, 61.0, "first", "x/k1.jpg"), ("r", 2, 1, 61.0, 70.0, None, None), ("r", 3, 2, 60.0, 90.0, "third", None)]
    units = spark.createDataFrame(rows, "run_id string, unit_no int, group_no int, s double, e double, summary string, image string")
    text = reports.outline(units).first().markdown
    assert text.startswith("## Topic 001\n\n### Unit 001 (00:00:00 - 00:01:01)\n\nfirst\n\n![unit 001](assets/keyframes/k1.jpg)\n\n### Unit 002") and text.endswith("### Unit 003 (00:01:00 - 00:01:30)\n\nthird\n")
    assert tuple(reports.summary(units).first()) == ("r", 3, 2, 1, False)


def test_sessions_are_alike_in_batch_and_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    path = str(tmp_path / "in")
    events.repartition(2).write.parquet(path)
    batch = sessions.sessions(spark.read.parquet(path))
    stream = sessions.sessions(spark.readStream.schema(events.schema).parquet(path), late="3650 days")
    query = stream.writeStream.format("memory").queryName("held").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("held").collect())) == sorted(map(tuple, batch.collect()))


def test_units_run_what_gives_their_segments_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kinds = "run_id string, seg_id long, visual long, visual_id long, s double, e double, chars long, text string"
    rows = spark.createDataFrame([("a", k, k // 3, 10 + k // 3, 20.0 * k, 20.0 * k + 15, 50, f"t{k}") for k in range(30)], kinds)
    held = content_map.with_excerpts(content_map.units(rows.mapInArrow(counted, kinds), folds.Options()))
    held.join(content_map.topic_groups(held), ["run_id", "unit_no"]).collect()
    assert seen.value == 30
