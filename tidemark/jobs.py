"""Whole stages of runs, from tables to tables: visual evidence, and content maps. Each returns its outputs by name; nothing is collected."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import content_map, digests, folds, gates, reports, transcription, visual_runs
from .operators import frames as frame_features
from .sources import documents, probes
from .sources import options as settings_of
from .work import folder, settled

STAGES = "run_id long, kind string, number long, id long, t double, what string, covered array<double>, reasons array<string>, overridden array<string>, group_no long, selected double, source string, matched double"


def _staged(frames: list[dict], o: dict) -> list[dict]:
    """What each stage decides of one run's frames, a row a decision."""
    collapse = folds.Collapse.of(o)
    initial, decisions = folds.select_keyframes(frames, folds.Selection.of(o))
    rows = [{"kind": "decision", "id": f["id"], "t": f["t"], "what": what} for f, what in decisions]
    rows += [{"kind": "initial", "id": f["id"], "t": f["t"]} for f in initial]
    kept = initial
    if o["animation_collapse_enabled"]:
        kept, summary = folds.collapse_run(initial, collapse)
        stands = {f["group_no"]: f["t"] for f in kept if f["group_no"] is not None}
        rows += [{"kind": "suppressed", "id": f["id"], "t": f["t"], "group_no": k, "selected": stands[k]} for k, f in summary["suppressed"]]
        rows += [{"kind": "group", "id": f["id"], "t": f["t"], "group_no": f["group_no"], "selected": f["t"]} for f in kept if f["group_no"] is not None]
        bare = folds.boundary_reasons(initial, replace(collapse, strong_title=-1.0))
        last = initial[:1]
        for number, ((f, reasons), (_, all_reasons)) in enumerate(zip(folds.boundary_reasons(initial, collapse), bare, strict=True), 1):
            gone = [] if reasons else [r for r in all_reasons if r in ("gap", "hash", "span")]
            rows.append({"kind": "boundary", "number": number, "what": "grouping", "id": f["id"], "t": last[0]["t"], "selected": f["t"], "reasons": reasons, "overridden": gone})
            last = [f]
        for number, (before, f, reasons) in enumerate(folds.merge_reasons(initial, collapse), len(initial)):
            rows.append({"kind": "boundary", "number": number, "what": "merge", "id": f["id"], "t": before["t"], "selected": f["t"], "reasons": reasons, "overridden": []})
    rows += [{"kind": "pre_collapse", "id": f["id"], "t": f["t"]} for f in kept]
    if o["low_content_lookahead_enabled"] and o["title_only_penalty_enabled"]:  # without the penalty no state counts as low
        kept, low = folds.suppress_low_content(kept, frames, folds.Lookahead.of(o))
        for number, (early, how, found) in enumerate(low, 1):
            pool = how == "initial_selection_miss"
            source = None if found is None else "candidate_pool" if pool else "keyframes"
            rows.append({"kind": "low", "number": number, "id": early["id"], "t": early["t"], "selected": found and found["t"], "source": source, "matched": found["t"] if found and pool else None})
    return rows + [{"kind": "final", "id": f["id"], "t": f["t"], "covered": f["covered"], "what": f["why"]} for f in kept]


def _features(frames: DataFrame, options: dict, out: str) -> DataFrame:
    """Frames with features: made from their gray values by the options, or as they came, if no option asks for anything else."""
    if "px" in frames.columns:
        return settled(frame_features.described(frames, options), f"{out}/frames")
    plain = settings_of.visual({})
    asked = [key for key in (*settings_of.quality_thresholds(plain), *[k for k in plain if k.startswith("comparison_")]) if options[key] != plain[key]]
    if asked:
        raise ValueError(f"frames without gray values (px, width, height) can't be judged by {', '.join(sorted(asked))}")
    legacy = "content_fullness_legacy"
    if options["final_state_preference"] == legacy and not options["fuller_state_scoring_enabled"] and not {"variance", "sharpness"} <= set(frames.columns):
        raise ValueError(f"{legacy} needs the frames' variance and sharpness")
    return frames


def visual(runs: DataFrame, frames: DataFrame, options: dict, out: str) -> dict[str, DataFrame]:
    """Keyframes, visual segments, traces and reports of runs, with what each stage decided below ``out``.

    runs: run_id, video_path, smoke_test, duration, error_type, warnings; a run with an error, without any frame kept, whose first keyframe is lower than
    min_keyframe_height, or whose frames changed while they were read, has a failed report and no segments. frames: run_id, id, t, and either gray values
    (px, width, height; see :mod:`tidemark.operators.frames`) or features as :mod:`folds` names them. options: from options.visual(); an option that
    can't act on such frames is refused."""
    before = settled(digests.sources({"frames": frames}), f"{out}/inputs")
    given, frames = frames, _features(frames, options, out)
    usable = frames.join(runs.where("error_type IS NULL").select("run_id"), "run_id", "left_semi")
    folds.per_run(usable, lambda rows: _staged(rows, options), STAGES, ["t", "id"]).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/stages")
    # numbered folders are read back with the types they were written with
    staged = frames.sparkSession.read.schema(STAGES.replace("run_id long", f"run_id {frames.schema['run_id'].dataType.simpleString()}")).parquet(f"{out}/stages")
    moved = settled(digests.changed(before, digests.sources({"frames": given})).select("run_id").distinct(), f"{out}/moved")
    low_runs = _too_low(staged, frames, options)
    refused = moved.withColumn("why", F.lit("InputsChanged")).union(low_runs.withColumn("why", F.lit("KeyframeResolutionBelowMinimum"))).groupBy("run_id").agg(F.min("why").alias("why"))
    shown = staged.join(refused, "run_id", "left_anti")
    of = lambda kind: (shown if kind == "final" else staged).where(F.col("kind") == kind)
    keyframes = visual_runs.keyframe_files(of("final").select("run_id", "id", "t", "covered", F.col("what").alias("why")))
    order = Window.partitionBy("run_id").orderBy("number")
    spans = keyframes.join(runs.select("run_id", "duration"), "run_id").withColumn("e", F.coalesce(F.lead("t").over(order), F.greatest("duration", F.col("t") + options["frame_interval_seconds"])))
    segments = spans.select("run_id", F.col("t").alias("s"), "e", F.col("number").cast("long").alias("seg_id"), "file", "covered", "why")
    names = {"candidates": "decision", "initial": "initial", "pre_collapse": "pre_collapse", "final": "final"}
    points = staged.join(F.broadcast(staged.sparkSession.createDataFrame(list(names.items()), "side string, kind string")), "kind").select("run_id", "side", "t")
    groups = staged.where(F.col("kind").isin("suppressed", "group")).select("run_id", "group_no", "t", F.col("selected").alias("representative"))
    low = of("low").select("run_id", "number", F.col("t").alias("at"), "selected", "source", "matched")
    boundaries = of("boundary").select("run_id", "number", F.col("what").alias("pass"), F.col("t").alias("at"), "selected", "reasons", "overridden")
    windows = visual_runs.trace_windows(low, boundaries.where("pass = 'grouping'").drop("pass"), options["low_content_lookahead_seconds"])
    if not options["final_state_trace_enabled"]:
        windows = windows.where("false")
    counts = [
        visual_runs.selection_counts(of("decision").select("run_id", "id", "t", F.col("what").alias("decision")), options["max_keyframes"]),
        visual_runs.boundary_counts(boundaries),
        of("suppressed").groupBy("run_id").agg(F.count(F.lit(1)).alias("intermediate_suppressed_count"), F.count_distinct("group_no").alias("collapsed_group_count")),
        of("final").groupBy("run_id").agg(F.count(F.lit(1)).alias("keyframe_count")),
        frames.groupBy("run_id").agg(F.count(F.lit(1)).alias("frame_count")),
    ]
    kept = runs.join(keyframes.select("run_id").distinct().withColumn("kept", F.lit(True)), "run_id", "left")
    kept = kept.join(refused, "run_id", "left")
    judged = kept.withColumn("error_type", F.coalesce("error_type", "why", F.when(F.col("kept").isNull(), F.lit("NoKeyframes")))).drop("kept", "why")
    held = visual_runs.report(judged, counts, options)
    listed = visual_runs.limited(boundaries, [F.col("number")], options["report_group_decisions_limit"])
    if not options["collapse_report_enabled"]:
        listed = listed.where("false")
    return {"keyframes": keyframes, "segments": segments, "trace": visual_runs.trace(windows, points, groups, options["final_state_trace_report_limit"]), "boundaries": listed, "reports": held, "documents": visual_runs.segment_documents(held, segments)}


def visual_documents(got: dict[str, DataFrame]) -> DataFrame:
    """(run_id, name, body): the visual segments and the report of each run of visual(), those of a smoke test under names of their own."""
    smoke = F.coalesce(F.col("smoke_test"), F.lit(False))
    named = lambda what: F.when(smoke, f"audit/{what}.smoke.json").otherwise(f"audit/{what}.json")
    reports_ = got["reports"]
    held = got["documents"].join(reports_.select("run_id", "smoke_test"), "run_id")
    fields = [c for c in got["documents"].columns]
    return documents.as_json(held, named("visual_segments"), fields).union(documents.as_json(reports_, named("frame_report"))).select(F.col("run_id").cast("string").alias("run_id"), "name", "body")


def transcriptions(runs: DataFrame, segments: DataFrame, options: dict, forced: bool = False) -> dict[str, DataFrame]:
    """Reports of all runs, and the transcript heads and files of those that were transcribed.

    runs: as transcription.gate() takes them; segments: run_id, pos, s, e, text, language, what was recognized; options: from options.transcription()."""
    gated = transcription.gate(runs, options, forced)
    ready = segments.join(gated.where("status = 'ready'").select("run_id"), "run_id", "left_semi")
    done = settled(transcription.reports(gated, ready), f"{folder(runs.sparkSession)}/reports")
    heads = transcription.transcripts(done)
    smoke = F.when(F.col("smoke_test"), "audit/transcription_report.smoke.json").otherwise("audit/transcription_report.json")
    files = documents.as_json(done, smoke).union(documents.raw_transcripts(heads, ready))
    return {"reports": done, "transcripts": heads, "files": files.select(F.col("run_id").cast("string").alias("run_id"), "name", "body")}


def downloads(found: DataFrame, probed: DataFrame, options: dict) -> dict[str, DataFrame]:
    """Reports on what was downloaded, and the part that runs' metadata take over.

    found: run_id, body (what the downloader says), video_path, messages; probed: run_id, body, return_code, message; options: from options.acquisition()."""
    seen = probes.video_metadata(probed).select("run_id", "video")
    held = probes.requested_formats(found).join(seen, "run_id", "left")
    told = settled(probes.download_reports(held, options["preferred_video_height"]), f"{folder(found.sparkSession)}/reports")
    return {"reports": told, "acquisition": probes.acquisition(told), "files": documents.as_json(told, "audit/download_report.json").select(F.col("run_id").cast("string").alias("run_id"), "name", "body")}


def _too_low(staged: DataFrame, frames: DataFrame, options: dict) -> DataFrame:
    """run_id of runs whose first keyframe's height is known and below min_keyframe_height."""
    if "height" not in frames.columns:
        return staged.select("run_id").where("false")
    first = staged.where("kind = 'final'").groupBy("run_id").agg(F.min(F.struct("t", "id"))["id"].alias("id"))
    return first.join(frames.select("run_id", "id", "height"), ["run_id", "id"]).where(F.col("height") < options["min_keyframe_height"]).select("run_id").distinct()


def content_maps(alignment: DataFrame, alignment_reports: DataFrame, transcript: DataFrame, visual_segments: DataFrame, features: DataFrame, options: dict, runs: DataFrame | None = None, lost_keyframes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Units with images and topic groups, requests, sections, review reports, outlines and handouts of the runs that pass the gates; ``errors`` of the others.

    alignment and its reports: from gates.align_runs(); transcript, visual_segments: as that takes them; features: run_id, seg_id (of the
    visual segment), t, hist, hash, content, detail. options: from options.content_map(). runs (run_id, frame_status, visual_status, smoke_test,
    language) and lost_keyframes: as gates.content_map_violations() takes them. Units and images are written once below spark.checkpoint.dir and all
    outputs read from there; a run whose inputs changed meanwhile is refused."""
    path = folder(alignment.sparkSession)
    backend = settings_of.backend(options)
    backend.checked(options)
    inputs = {"alignment": alignment, "transcript": transcript, "visual_segments": visual_segments, "features": features}
    before = settled(digests.sources(inputs), f"{path}/inputs")
    found_errors = gates.content_map_violations(alignment_reports, alignment, transcript, visual_segments, runs, lost_keyframes)
    errors = settled(gates.first_errors(found_errors), f"{path}/errors")
    passed = alignment.join(errors, "run_id", "left_anti")
    seen = gates.numbered(visual_segments).select("run_id", F.col("id").alias("visual_id"), (F.col("pos") + 1).cast("int").alias("visual"))
    texts = transcript.select("run_id", F.col("pos").alias("transcript_index"), "s", "e", "text", F.coalesce("id", F.col("pos") + 1).alias("seg_id"))
    items = passed.select("run_id", "transcript_index", F.col("matched_visual_segment_id").alias("visual_id")).join(texts, ["run_id", "transcript_index"]).join(seen, ["run_id", "visual_id"])
    items = items.select("run_id", "seg_id", "s", "e", F.char_length("text").cast("long").alias("chars"), "text", "visual", "visual_id")
    limits = folds.Options(options["content_unit_max_duration_seconds"], options["content_unit_max_gap_seconds"], least_chars=options["content_unit_min_transcript_chars"])
    images = folds.Images.of(options)
    held = settled(content_map.with_excerpts(content_map.units(items, limits)), f"{path}/held")
    found = settled(content_map.candidates(held, features.withColumn("id", F.col("seg_id"))), f"{path}/candidates")
    whole = held.join(content_map.select_images(found, o=images), ["run_id", "unit_no"], "left")
    none = F.array().cast("array<struct<id:bigint,t:double,reason:string>>")
    whole = whole.withColumns({"dropped": F.coalesce("dropped", none), "warnings": F.coalesce("warnings", F.array(F.lit("no_selected_handout_image"))), "review_required": F.coalesce("review_required", F.lit(True))})
    whole = whole.join(content_map.topic_groups(held), ["run_id", "unit_no"])
    whole = content_map.review_points(whole.withColumns({"n_visuals": F.size("visuals"), "n_candidates": F.size("visuals"), "n_selected": F.col("selected").isNotNull().cast("int")}))
    whole = settled(whole, f"{path}/whole")
    groups = settled(content_map.image_groups(found, images), f"{path}/groups")
    moved = settled(digests.changed(before, digests.sources(inputs)).select("run_id").distinct(), f"{path}/moved")
    errors = errors.union(moved.join(errors, "run_id", "left_anti").select("run_id", F.lit("InputsChanged").alias("error_type"), F.lit(-1).cast("long").alias("error_pos")))
    whole, groups = whole.join(moved, "run_id", "left_anti"), groups.join(moved, "run_id", "left_anti")
    if not options["generate_content_map"]:
        whole, groups = whole.where("false"), groups.where("false")
    requests = content_map.requests(whole, options["llm_max_excerpt_chars_per_item"], options["llm_max_input_chars_per_unit"], options["llm_max_output_tokens"], options["output_language"])
    made = options["generate_llm_prompt_pack"]
    packs = content_map.pack_descriptor(whole, options["llm_prompt_pack_path"], made)
    count = lambda rows, name: rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    health = alignment_reports.select("run_id", "status", F.col("aligned_count").alias("aligned_segment_count"), F.col("unaligned_count").alias("unaligned_segment_count"), F.col("low_confidence_count").alias("low_confidence_segment_count"))
    for rows, name in ((transcript, "transcript_segment_count"), (visual_segments, "visual_segment_count"), (alignment, "alignment_item_count")):
        health = health.join(count(rows, name), "run_id", "left")
    hashes = before.select("run_id", "source", F.concat_ws("-", "n_rows", "a", "b").alias("hash"))
    review = content_map.review_report(whole, groups, health, hashes, packs, options["content_map_known_issues"])
    imaged = whole.withColumn("image", F.col("selected").cast("string"))
    languages = runs.select("run_id", "language") if runs is not None and "language" in runs.columns else alignment_reports.select("run_id", F.lit(None).cast("string").alias("language"))
    handouts = reports.handout(imaged, languages, options["handout_include_timestamps"], options["handout_include_generated_notice"])
    asked = lambda rows, key: rows if options[key] else rows.where("false")
    return {
        "units": whole,
        "image_groups": groups,
        "requests": asked(requests, "generate_llm_prompt_pack"),
        "prompt_packs": packs,
        "summaries": content_map.validation_summary(whole, groups),
        "review_reports": asked(review, "generate_review_report"),
        "outlines": asked(reports.outline(imaged), "generate_lecture_handout"),
        "handouts": asked(handouts, "generate_lecture_handout"),
        "errors": errors,
    }


def content_map_documents(got: dict[str, DataFrame], options: dict) -> DataFrame:
    """(run_id, name, body): the files of content maps (from content_maps()) that a run has: its map, its prompt pack as JSON lines, its review report and its handout."""
    maps = got["summaries"].select("run_id", F.struct(*[c for c in got["summaries"].columns if c != "run_id"]).alias("validation_summary"))
    units = got["units"].drop("items").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", *[c for c in got["units"].columns if c not in ("run_id", "unit_no", "items")]))).alias("content_units"))
    parts = [
        documents.as_json(maps.join(units, "run_id"), "audit/content_map.json"),
        documents.as_lines(got["requests"], options["llm_prompt_pack_path"], "unit_id"),
        got["review_reports"].select("run_id", F.lit("audit/review_report.md").alias("name"), F.col("markdown").alias("body")),
        got["handouts"].select("run_id", F.lit("lecture_handout.md").alias("name"), F.col("markdown").alias("body")),
    ]
    return reduce(DataFrame.union, [p.select(F.col("run_id").cast("string").alias("run_id"), "name", "body") for p in parts])
