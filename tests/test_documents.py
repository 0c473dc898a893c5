"""The sink of run documents and published snapshots, failures in the middle included."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import artifacts, documents, snapshots


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def test_documents_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'é "x"', None, 2.5), (2, "", 7, 0.0)], "run_id long, title string, n long, s double")
    documents.write(documents.as_json(rows, "audit/report.json"), f"{tmp_path}/runs")
    text = (tmp_path / "runs/1/audit/report.json").read_text()
    assert text == '{\n  "run_id": 1,\n  "title": "é \\"x\\"",\n  "n": null,\n  "s": 2.5\n}\n'
    back = artifacts.read_json(spark, f"{tmp_path}/runs/*/audit/report.json", "run_id long, title string, n long, s double")
    assert sorted(map(tuple, back.collect())) == [(1, 'é "x"', None, 2.5), (2, "", 7, 0.0)]
    assert files(tmp_path / "runs") == ["1/audit/report.json", "2/audit/report.json", "_SUCCESS"] and (tmp_path / "runs/_SUCCESS").read_text() == "2"


def test_lines_text_and_bytes(spark, tmp_path):
    units = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "x"), (5, 1, "c", None)], "run_id long, unit_no int, text string, image string")
    documents.write(documents.as_lines(units, "audit/pack.jsonl", "unit_no"), str(tmp_path))
    assert [json.loads(x) for x in (tmp_path / "1/audit/pack.jsonl").read_text().splitlines()] == [{"run_id": 1, "unit_no": 1, "text": "a", "image": "x"}, {"run_id": 1, "unit_no": 2, "text": "b", "image": None}]
    documents.write(spark.createDataFrame([(1, "r.md", "# R\n\n \n"), (1, "none.md", None)], "run_id long, name string, body string"), str(tmp_path))
    assert (tmp_path / "1/r.md").read_text() == "# R\n" and not (tmp_path / "1/none.md").exists()
    frames = spark.createDataFrame([(1, 7, bytearray(b"\xff\xd8x\n\n")), (1, 8, bytearray(b"y"))], "run_id long, id long, content binary")
    documents.write(documents.keyframe_files(spark.createDataFrame([(1, 7, "keyframe_0001.jpg"), (1, 9, "keyframe_0002.jpg")], "run_id long, id long, file string"), frames), str(tmp_path))
    assert (tmp_path / "1/assets/keyframes/keyframe_0001.jpg").read_bytes() == b"\xff\xd8x\n\n"
    assert len(list((tmp_path / "1/assets/keyframes").glob("*.jpg"))) == 1


def test_a_failed_job_leaves_no_document(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.col("id").alias("run_id"), F.lit("a.json").alias("name"), F.when(F.col("id") == 33, "{").otherwise("{}").alias("body"))
    with pytest.raises(Exception, match="(?i)json|expecting"):
        documents.write(rows, f"{tmp_path}/runs")
    assert files(tmp_path) == []
    documents.write(rows.where("run_id <> 33"), f"{tmp_path}/runs")
    assert len(files(tmp_path)) == 40


@pytest.mark.parametrize("name", ["../x.json", "/x.json", "a/../../x", "_hidden", "a\\b", ""])
def test_names_stay_below_their_run(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a name below a run"):
        documents.write(spark.createDataFrame([(1, name, "{}")], "run_id long, name string, body string"), str(tmp_path / "runs"))
    assert files(tmp_path) == []


@pytest.mark.parametrize("smoke", [False, True])
def test_raw_transcripts(spark, smoke):
    heads = spark.createDataFrame([(1, ("faster_whisper_fallback", smoke), True, "r", 9), (2, ("x", None), False, None, 0)], "run_id long, source struct<type: string, smoke_test: boolean>, fallback_required boolean, fallback_reason string, segment_count long")
    segments = spark.createDataFrame([(1, 1, 4.0, 5.0, "b"), (1, 0, 1.0, 2.0, "a")], "run_id long, pos int, s double, e double, text string")
    got = {r.run_id: (r.name, json.loads(r.body)) for r in documents.raw_transcripts(heads, segments).collect()}
    assert got[1][0] == ("audit/raw_transcript.smoke.json" if smoke else "audit/raw_transcript.json")
    assert got[1][1] == {"run_id": 1, "source": {"type": "faster_whisper_fallback", "smoke_test": smoke}, "fallback_required": True, "fallback_reason": "r", "segments": [{"start_time": 1.0, "end_time": 2.0, "text": "a"}, {"start_time": 4.0, "end_time": 5.0, "text": "b"}], "segment_count": 2}
    assert got[2][1]["segments"] == [] and got[2][1]["segment_count"] == 0 and got[2][1]["fallback_reason"] is None


def test_run_metadata(spark):
    runs = spark.createDataFrame([("r1", "u", "out", "zh-CN")], "run_id string, video_url string, output_dir string, output_language string")
    held = json.loads(documents.run_metadata(runs, F.lit("2020-01-02T03:04:05").cast("timestamp")).first().body)
    assert held == {"run_id": "r1", "video_url": "u", "output_dir": "out", "output_language": "zh-CN", "created_at": "2020-01-02T03:04:05Z", "status": "initialized"}


def test_snapshots(spark, tmp_path):
    root = f"{tmp_path}/job"
    with pytest.raises(snapshots.NotPublished):
        snapshots.table(spark, root, "a")
    first = snapshots.begin(spark, root)
    with pytest.raises(snapshots.NotPublished):
        snapshots.publish(first)
    snapshots.add(first, "a", spark.range(3))
    snapshots.add(first, "b", spark.range(5).withColumnRenamed("id", "run_id").withColumn("x", F.lit(1)), by_run=True)
    with pytest.raises(snapshots.NotPublished):
        snapshots.table(spark, root, "a")
    snapshots.publish(first)
    assert snapshots.table(spark, root, "a").count() == 3 and snapshots.table(spark, root, "b").count() == 5
    # a job that ends between two outputs: the old set is seen whole
    second = snapshots.begin(spark, root)
    snapshots.add(second, "a", spark.range(9))
    with pytest.raises(Exception, match="boom"):
        snapshots.add(second, "b", spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("x")))
    assert snapshots.current(spark, root)["version"] == first.name and snapshots.table(spark, root, "a").count() == 3
    third = snapshots.begin(spark, root)
    snapshots.add(third, "a", spark.range(7))
    snapshots.publish(third)
    assert snapshots.table(spark, root, "a").count() == 7
    with pytest.raises(snapshots.NotPublished, match="no b"):
        snapshots.table(spark, root, "b")
    assert snapshots.vacuum(spark, root) == 2 and snapshots.vacuum(spark, root) == 0
    assert snapshots.table(spark, root, "a").count() == 7
