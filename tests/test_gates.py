"""Gates: which runs pass, and what the others are told first."""

import json
from pathlib import Path

from tidemark.operators import gates
from tidemark.sources import snapshots


def tables(spark, n=4):
    """The small run of two transcript rows a window, and runs that each break something."""
    t, v, runs = [], [], []
    for run in ("good", "smoke", "short", "text", "order", "novisual", "noreport", "failed"):
        for i in range(n):
            for o in range(2):
                t.append((run, 2 * i + o, 2 * i + o + 1, 10.0 * i + 5 * o, 10.0 * i + 5 * o + 4, f"Excerpt {i} {o}"))
            if run != "novisual":
                v.append((run, i, 0 if i == 0 else i + 1, 10.0 * i, 10.0 * i + 10, f"k{i}.jpg"))
        runs.append((run, {"noreport": None, "failed": "failed"}.get(run, "success"), run == "smoke"))
    t = [(*r[:5], " \t") if r[0] == "text" and r[1] == 3 else r for r in t]
    t = [(*r[:3], 9.0, 9.0, r[5]) if r[0] == "order" and r[1] == 1 else r for r in t]
    t += [("short", 8, 9, 90.0, 99.0, "late")]
    return (
        spark.createDataFrame(runs, "run_id string, status string, smoke_test boolean"),
        spark.createDataFrame(t, "run_id string, pos long, id long, s double, e double, text string"),
        spark.createDataFrame(v, "run_id string, pos long, id long, s double, e double, keyframe_path string"),
    )


def test_alignment_gates(spark):
    runs, t, v = tables(spark)
    aligned, reports = gates.align_runs(runs, t, v)
    got = {r.run_id: (r.status, r.error_type, r.error_pos, r.aligned_count) for r in reports.collect()}
    assert got == {
        "good": ("success", None, None, 8),
        "smoke": ("failed", "VisualEvidenceIsSmoke", -1, None),
        "short": ("failed", "VisualCoverageTooShort", -1, None),
        "text": ("failed", "InvalidTranscriptSegment", 3, None),
        "order": ("failed", "InvalidTimeline", 1, None),
        "novisual": ("failed", "MissingVisualSegments", -1, None),
        "noreport": ("failed", "MissingFrameReport", -1, None),
        "failed": ("failed", "MissingFrameReport", -1, None),
    }
    rows = aligned.orderBy("transcript_index").collect()
    assert [(r.matched_visual_segment_id, r.overlap_seconds, r.confidence) for r in rows] == [(i // 2 + 1, 4.0, "high") for i in range(8)]


def test_content_map_gates(spark):
    runs, t, v = tables(spark)
    one = lambda df: df.where("run_id = 'good'")
    runs, t, v = one(runs), one(t), one(v)
    aligned, reports = gates.align_runs(runs, t, v)
    assert gates.content_map_violations(reports, aligned, t, v).collect() == []
    fewer = aligned.where("transcript_index <> 2")
    found = gates.content_map_violations(reports, fewer, t, v.where("pos <> 3").unionByName(v.where("pos = 1")))
    assert {r.error_type for r in found.collect()} == {"TranscriptNotAligned", "UnknownVisualSegment", "DuplicateVisualSegment"}
    assert gates.first_errors(found).first().error_type == "UnknownVisualSegment"


def test_command_line(spark, tmp_path):
    from tidemark.__main__ import main

    paths = [str(tmp_path / name) for name in ("runs", "transcript", "visual")]
    for df, path in zip(tables(spark), paths, strict=True):
        df.write.parquet(path)
    out = str(tmp_path / "out")
    assert main(["align", *paths, out]) == 1
    assert spark.read.parquet(f"{out}/alignment").where("run_id = 'good'").count() == 8
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nHello\n")
    assert main(["subtitles", str(tmp_path / "a.vtt"), str(tmp_path / "cues")]) == 0
    assert spark.read.parquet(str(tmp_path / "cues")).first().text == "Hello"


def test_command_line_of_content_maps(spark, tmp_path):
    from tidemark.__main__ import main

    runs, t, v = [df.where("run_id IN ('good', 'failed')") for df in tables(spark)]
    features = v.selectExpr("run_id", "pos + 1 AS seg_id", "s AS t", "array(1D) AS hist", "array(1) AS hash", "0.5D AS content", "0.1D AS detail")
    paths = {name: str(tmp_path / name) for name in ("runs", "transcript", "visual", "features")}
    for path, df in zip(paths.values(), (runs, t, v, features), strict=True):
        df.write.parquet(path)
    (tmp_path / "settings.yaml").write_text("video_url: u\nrun_id: r\noutput_dir: o\ngenerate_lecture_handout: no\n")
    aligned, out = str(tmp_path / "aligned"), str(tmp_path / "out")
    assert main(["align", paths["runs"], paths["transcript"], paths["visual"], aligned]) == 1
    assert main(["content-map", str(tmp_path / "settings.yaml"), aligned, paths["transcript"], paths["visual"], paths["features"], out]) == 1
    of = lambda name: snapshots.table(spark, out, name)
    assert [r.run_id for r in of("units").collect()] == ["good"]
    assert [r.error_type for r in of("errors").collect()] == ["AlignmentFailed"]
    assert of("outlines").count() == 0
    files = Path(snapshots.path_of(spark, out, "files"))
    assert sorted(str(p.relative_to(files)) for p in files.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["_SUCCESS", "good/audit/content_map.json", "good/audit/handout_prompt_pack.jsonl", "good/audit/review_report.md"]
    assert json.loads((files / "good/audit/content_map.json").read_text())["validation_summary"]["content_unit_count"] >= 1
