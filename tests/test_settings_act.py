"""Every setting of the visual stages and of content maps changes a result or is refused; features of regions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import content_map, folds, frames, reports
from tidemark.sources import options

FRAMES = {"run_id": 1, "hist": [1.0], "hash": [0] * 8, "title": [0] * 4, "slide": [0] * 8, "content": 0.2, "detail": 0.1, "layout": 0.2, "ok": True}


def frame(i, t, **more):
    return {**FRAMES, "id": i, "t": float(t), **more}


def folded(settings, rows):
    o = options.visual(settings)
    kept = folds.select_keyframes(rows, folds.Selection.of(o))[0]
    return [f for _, representatives in folds.collapse(kept, folds.Collapse.of(o)) for f in representatives]


@pytest.mark.parametrize(("settings", "kept"), [
    ({}, [2]), ({"fuller_state_weight": 0}, [3]), ({"content_area_weight": 0, "detail_density_weight": 9}, [1]), ({"layout_richness_weight": 30}, [3]),
    ({"time_preference_weight": 9}, [3]), ({"fuller_state_scoring_enabled": "no", "final_state_preference": "latest_stable"}, [3]),
    ({"fuller_state_scoring_enabled": "no", "final_state_preference": "content_fullness_legacy"}, [1]), ({"fuller_state_scoring_enabled": "no", "final_state_preference": "content_fullness"}, [2]),
])
def test_weights_and_preferences_choose_the_representative(settings, kept):
    rows = [frame(1, 0, detail=0.9, content=0.1, layout=0.1, variance=9.0, sharpness=1.0, hist=[1.0, 0.0]), frame(2, 30, content=0.9, hist=[0.8, 0.2]), frame(3, 60, layout=0.5, hist=[0.6, 0.4])]
    assert [f["id"] for f in folded({"min_visual_difference_score": 0.1, "group_fullness_reset_min_delta": 99, "min_stable_duration_seconds": 1, **settings}, rows)] == kept


def test_scoring_off_replaces_no_keyframe():
    rows = [frame(1, 0), frame(2, 5, content=0.9)]
    assert [f["id"] for f in folded({}, rows)] == [2] and [f["id"] for f in folded({"fuller_state_scoring_enabled": "no"}, rows)] == [1]


IMAGES = [{"id": k, "t": t, "hist": [1.0, 0.0] if k < 7 else [0.7, 0.3], "hash": [0, 1], "content": 1 / k, "detail": 0.1} for k, t in enumerate((0, 10, 20, 100, 130, 300, 330), 1)]


@pytest.mark.parametrize(("settings", "groups"), [
    ({}, [("rapid_visual_burst", [1, 2, 3]), ("near_duplicate_visual_pair", [4, 5])]),
    ({"handout_rapid_burst_min_frames": 4}, [("near_duplicate_visual_pair", [1, 2, 3]), ("near_duplicate_visual_pair", [4, 5])]),
    ({"handout_rapid_burst_window_seconds": 15}, [("near_duplicate_visual_pair", [1, 2, 3]), ("near_duplicate_visual_pair", [4, 5])]),
    ({"handout_near_duplicate_max_gap_seconds": 15}, [("rapid_visual_burst", [1, 2, 3])]),
    ({"handout_near_duplicate_max_difference": 0.5}, [("rapid_visual_burst", [1, 2, 3]), ("near_duplicate_visual_pair", [4, 5]), ("near_duplicate_visual_pair", [6, 7])]),
])
def test_image_settings(settings, groups):
    o = folds.Images.of(options.content_map(settings))
    assert [(kind, [f["id"] for f in members]) for kind, members in folds.image_groups(IMAGES, o)] == groups


def test_fuller_images_or_the_latest():
    assert folds.best_image(IMAGES)["id"] == 1 and folds.best_image(IMAGES, folds.Images.of(options.content_map({"handout_prefer_fuller_state": "no"})))["id"] == 7


UNITS = "run_id string, unit_no int, group_no int, s double, e double, image string, excerpts array<struct<text: string>>, points array<string>, selected long, n_candidates int, dropped array<struct<id: long, t: double, reason: string>>"


def units(spark):
    return spark.createDataFrame([("r", 2, 1, 60.0, 90.0, None, [("b",)], ["no_selected_image"], None, 3, [(7, 1.0, "x_reason")]), ("r", 1, 1, 0.0, 59.0, "a\\b c.jpg", [("a",), ("d",), ("e",), ("f",)], [], 5, 1, [])], UNITS)


def test_handout(spark):
    runs = spark.createDataFrame([("r", "en")], "run_id string, language string")
    text = reports.handout(units(spark), runs).first().markdown
    lines = text.split("\n")
    assert lines[0] == reports.HANDOUT_TITLE + "r" and lines[2] == reports.HANDOUT_NOTICE and lines[-1] == "" and lines[-2] == reports.CLOSING[1]
    assert text.index("教学单元 001") < text.index("教学单元 002") and "00:00:00 - 00:00:59" in text and "- e\n" in text and "- f\n" not in text and text.count("![") == 1 and f"{reports.LANGUAGE_LABEL}：`en`" in text
    plain = reports.handout(units(spark), runs, timestamps=False, notice=False).first().markdown
    assert reports.HANDOUT_NOTICE not in plain and f"- {reports.SPAN_LABEL}：" not in plain


def test_review_report(spark):
    groups = spark.createDataFrame([("r", 1, "rapid_visual_burst", 5, True), ("r", 1, "rapid_visual_burst", 6, False)], "run_id string, group_no int, kind string, id long, kept boolean")
    health = spark.createDataFrame([("r", "success", 8)], "run_id string, status string, aligned_segment_count int")
    hashes = spark.createDataFrame([("r", "transcript", "abc")], "run_id string, source string, hash string")
    packs = spark.createDataFrame([("r", True, "audit/p.jsonl", 2, "v1")], "run_id string, generated boolean, path string, item_count int, schema_version string")
    text = content_map.review_report(units(spark), groups, health, hashes, packs, ["blurred at 10:00"]).first().markdown
    for line in ("- Content units: `2`", "- Topic groups: `1`", "- `status`: `success`", "- `transcript`: `abc`", "- `image_group_001` `rapid_visual_burst`: keep `5`; dropped `1` candidate(s).", "- `unit_002`: `7` - `x_reason`", "- Units without selected image: `unit_002`", "- Long transcript with little visual change: `none`", "- blurred at 10:00", "- Item count: `2`", "- Near-duplicate or density-control groups: `1`"):
        assert f"{line}\n" in text, line
    bare = content_map.review_report(units(spark).where("unit_no = 1")).first().markdown
    assert "No operator-supplied known issues." in bare and "- None." in bare and "Source Hashes" not in bare


def plain_features(px, w):
    """Features of a frame by slices of a matrix."""
    x = np.array(px).reshape(-1, w)
    h = len(x)

    def part(left, top, right, bottom):
        return x[int(h * top) : int(h * bottom), int(w * left) : int(w * right)]

    def bits(b):
        if not b.size:
            return []
        sides = [[(n * k // 8, max(n * (k + 1) // 8, n * k // 8 + 1)) for k in range(8)] for n in b.shape]
        means = [b[y0:y1, x0:x1].mean() for y0, y1 in sides[0] for x0, x1 in sides[1]]
        return [int(m > sum(means) / 64) for m in means]

    slide, title = part(*frames.SLIDE_BOX), part(*frames.TITLE_BOX)
    steps = np.concatenate([np.abs(np.diff(slide, axis=1)).ravel(), np.abs(np.diff(slide, axis=0)).ravel()]) if min(slide.shape) > 1 else np.zeros(1)
    gh, gw = slide.shape[0] // 4, slide.shape[1] // 4
    layout = np.mean([(slide[y * gh : (y + 1) * gh, z * gw : (z + 1) * gw] < 245).sum() > 0.08 * gh * gw for y in range(4) for z in range(4)]) if gh and gw else 0.0
    every = np.concatenate([np.abs(np.diff(x, axis=1)).ravel(), np.abs(np.diff(x, axis=0)).ravel()]) if min(x.shape) > 1 else np.zeros(1)
    return {"content": (slide < 245).mean() if slide.size else 0.0, "detail": (steps > 12).mean(), "layout": layout, "mean": x.mean(), "variance": x.var(), "sharpness": every.mean(), "slide": bits(slide), "title": bits(title), "hash": bits(x)}


def test_features_of_regions(spark):
    r = random.Random(3)
    rows = []
    for k, (w, h) in enumerate(((16, 9), (8, 8), (1, 5), (40, 30), (3, 2))):
        rows.append((1, k, float(k), w, h, [r.choice((0, 120, 250, 255)) if r.random() < 0.5 else r.randint(0, 255) for _ in range(w * h)]))
    rows += [(1, 8, 8.0, 4, 4, [1] * 15), (1, 9, 9.0, 4, 4, None), (1, 10, 10.0, 10, 10, [255] * 100)]
    table = spark.createDataFrame(rows, "run_id long, id long, t double, width int, height int, px array<int>")
    got = {x.id: x for x in frames.described(table, options.visual({})).collect()}
    for _, k, _, w, _, px in rows[:5]:
        for name, want in plain_features(px, w).items():
            have = got[k][name]
            assert have == want if isinstance(want, list) else abs(have - want) < 1e-9, (k, name, have, want)
        assert np.allclose(got[k].hist, np.bincount(px, minlength=256) / len(px))
    assert (got[8].ok, got[8].reasons, got[9].reasons) == (False, ["unreadable"], ["unreadable"])
    assert got[10].reasons == ["bright_frame", "near_solid_frame", "low_variance", "low_sharpness"] and got[3].ok
    cut = {x.id: x for x in frames.described(table, options.visual({"comparison_region_mode": "center_crop", "comparison_center_crop_percent": 0.5, "bright_frame_mean_threshold": 1, "solid_frame_variance_threshold": 1e9})).collect()}
    assert cut[3].region.status == "active" and cut[3].hash != got[3].hash and cut[3].reasons[0] == "bright_frame"
    middle = np.array(rows[3][5]).reshape(30, 40)[cut[3].region.top : cut[3].region.bottom, cut[3].region.left : cut[3].region.right]
    assert middle.shape == (15, 20) and np.allclose(cut[3].hist, np.bincount(middle.ravel(), minlength=256) / middle.size)


def test_settings_that_frames_cannot_follow_are_refused(spark, tmp_path):
    from tidemark import jobs

    plain = spark.createDataFrame([(1, 1, 0.0, [1.0], [1], [1], [1], 0.1, 0.1, 0.1, True)], "run_id long, id long, t double, hist array<double>, hash array<int>, title array<int>, slide array<int>, content double, detail double, layout double, ok boolean")
    runs = spark.createDataFrame([(1, "v", False, 5.0, None, None)], "run_id long, video_path string, smoke_test boolean, duration double, error_type string, warnings array<string>")
    for settings in ({"comparison_region_mode": "center_crop"}, {"min_sharpness_score": 3}, {"final_state_preference": "content_fullness_legacy", "fuller_state_scoring_enabled": "no"}):
        with pytest.raises(ValueError, match="can't be judged|needs the frames"):
            jobs.visual(runs, plain, options.visual(settings), str(tmp_path))


def test_visual_job_from_gray_values(spark, tmp_path):
    from tidemark import jobs

    r = random.Random(4)
    px = [[r.choice((0, 80, 160, 255)) for _ in range(64)] for _ in range(3)]
    rows = [(1, k, 30.0 * k, 8, 8, px[k]) for k in range(3)] + [(2, 9, 0.0, 8, 8, [0] * 64)]
    frames_ = spark.createDataFrame(rows, "run_id long, id long, t double, width int, height int, px array<int>")
    runs = spark.createDataFrame([(k, "v", False, 90.0, None, None) for k in (1, 2)], "run_id long, video_path string, smoke_test boolean, duration double, error_type string, warnings array<string>")
    of = lambda settings, out: {x.run_id: (x.status, x.error_type) for x in jobs.visual(runs, frames_, options.visual(settings), f"{tmp_path}/{out}")["reports"].collect()}
    assert of({"min_keyframe_height": 8}, "a") == {1: ("success", None), 2: ("failed", "NoKeyframes")}
    assert of({}, "b") == {1: ("failed", "KeyframeResolutionBelowMinimum"), 2: ("failed", "NoKeyframes")}
    got = jobs.visual(runs, frames_, options.visual({"min_keyframe_height": 8, "collapse_report_enabled": "no"}), f"{tmp_path}/c")
    assert got["boundaries"].count() == 0 and sorted((x.run_id, x.name) for x in jobs.visual_documents(got).select(F.col("run_id"), "name").collect()) == [("1", "audit/frame_report.json"), ("1", "audit/visual_segments.json"), ("2", "audit/frame_report.json"), ("2", "audit/visual_segments.json")]
