"""Content maps: units of aligned transcript, their excerpts, images, topic groups, requests and review points.

Everything is a table by run. Splitting and merging are folds over one run's sorted array
in the JVM (:mod:`budgets`), as are excerpts and requests; only the choice of images
compares feature vectors and runs as a grouped fold (:mod:`folds`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..work import folder, settled
from . import budgets, chains, folds

# Fixed values of the format
REQUEST_SCHEMA = "handout_prompt_pack_v1"
SUMMARY_CHARS, EXCERPT_CHARS = 700, 280
GROUNDING_RULES = (
    "Only use the supplied transcript excerpts and visual metadata.",
    "Do not invent unsupported definitions, examples, or conclusions.",
    "Cite transcript item IDs and visual segment IDs from this unit only.",
    "Omit claims that cannot be grounded in supplied evidence.",
    "Return structured JSON; Markdown rendering happens later.",
)


def _merge_numbers(blocks: Column, o: folds.Options) -> Column:
    """For an array of blocks (visual, chunk, s, e, chars) in order, the unit of each, from 1: neighbours stay together while they may."""
    zero = F.lit(0.0)
    state = F.struct(F.lit(0).alias("k"), zero.alias("s"), zero.alias("e"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("visual"), budgets.grown("int").alias("out"))

    def step(held: Column, b: Column) -> Column:
        duration = b["e"] - held["s"]
        near = (b["s"] - held["e"] <= o.max_gap) & (duration <= o.max_duration) & (b["visual"] - held["visual"]).isin(0, 1)
        short = (duration <= min(o.max_duration, o.short)) | (held["chars"] < o.least_chars) | (b["chars"] < o.least_chars)
        joins = (held["k"] > 0) & near & short
        k = F.when(joins, held["k"]).otherwise(held["k"] + 1)
        return F.struct(
            k.alias("k"),
            F.when(joins, F.least(held["s"], b["s"])).otherwise(b["s"]).alias("s"),
            F.when(joins, F.greatest(held["e"], b["e"])).otherwise(b["e"]).alias("e"),
            (F.when(joins, held["chars"]).otherwise(0) + b["chars"]).alias("chars"),
            b["visual"].alias("visual"),
            budgets.added(held["out"], k).alias("out"),
        )

    return F.aggregate(blocks, state, step, lambda held: budgets.listed(held["out"]))


def units(items: DataFrame, o: folds.Options) -> DataFrame:
    """(run_id, unit_no, s, e, chars, items, visuals) of aligned segments (run_id, seg_id, s, e, chars, text, visual, visual_id).

    visual is the position of the matched visual segment in its run, visual_id its id. items holds the unit's segments in
    order, visuals its distinct visual ids in order."""
    # written once: chunks go over their rows several times, and what aligned them, as who uses the units, would run each time
    path = folder(items.sparkSession)
    items = settled(items.select("run_id", "visual", "s", "seg_id", "e", "chars", "text", "visual_id"), f"{path}/items")
    each = chains.chunked(items, ["run_id", "visual"], o.max_duration)
    blocks = each.groupBy("run_id", "visual", "chunk").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.sum("chars").cast("long").alias("chars"), F.array_sort(F.collect_list(F.struct("s", "seg_id", "e", "text", "visual_id"))).alias("items")
    )
    runs = blocks.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(F.col("visual").cast("long").alias("visual"), "chunk", "s", "e", "chars", "items"))).alias("blocks"))
    runs = runs.withColumn("k", _merge_numbers(F.col("blocks"), o))
    parts = runs.select("run_id", F.explode(F.arrays_zip("blocks", "k")).alias("x")).select("run_id", F.col("x.k").cast("long").alias("unit_no"), "x.blocks.*")
    found = parts.groupBy("run_id", "unit_no").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("visual", "chunk", "items"))).alias("b")
    )
    found = found.withColumn("items", F.flatten(F.transform("b", lambda x: x["items"]))).drop("b")
    return settled(found.withColumn("visuals", F.array_distinct(F.transform("items", lambda x: x["visual_id"]))), f"{path}/units")


def with_excerpts(held: DataFrame, most: int = EXCERPT_CHARS) -> DataFrame:
    """Units with ``excerpts`` (seg_id, s, e, text): first, middle and last segment, or all of up to three, each id once."""
    items, n = F.col("items"), F.size("items")
    at = F.when(n <= 3, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1))
    ids = F.transform(at, lambda k: F.get(items, k)["seg_id"])
    once = F.filter(at, lambda k, i: F.array_position(ids, F.get(items, k)["seg_id"]) == i + 1)
    picked = F.transform(once, lambda k: F.get(items, k))
    shown = F.transform(picked, lambda x: F.struct(x["seg_id"].alias("seg_id"), x["s"].alias("s"), x["e"].alias("e"), T.clip(x["text"], most).alias("text")))
    out = held.withColumn("excerpts", shown)
    return out.withColumn("summary", T.clip(F.array_join(F.transform("excerpts", lambda x: x["text"]), " / "), SUMMARY_CHARS))


def candidates(held: DataFrame, visual: DataFrame) -> DataFrame:
    """(run_id, unit_no, place, and visual's columns) of each unit's visual segments; visual: run_id, seg_id, ..."""
    each = held.select("run_id", "unit_no", F.posexplode("visuals").alias("place", "seg_id"))
    return each.join(visual, ["run_id", "seg_id"])


IMAGES = "run_id long, unit_no long, selected long, reason string, dropped array<struct<id:long,t:double,reason:string>>, warnings array<string>, review_required boolean"


def select_images(found: DataFrame, spacing: float = 45.0, o: folds.Images | None = None) -> DataFrame:
    """For each unit its image or none, the dropped ones with reasons, warnings and whether it needs review. found: candidates with features; o stands for spacing and all other settings."""
    o = o or folds.Images(spacing)

    def fold(rows: list[dict]) -> list[dict]:
        by_unit: dict[int, list[dict]] = {}
        for row in rows:
            by_unit.setdefault(row["unit_no"], []).append(row)
        numbers = sorted(by_unit)
        chosen, _ = folds.handout_images([by_unit[k] for k in numbers], o)
        return [{"unit_no": k, **image} for k, image in zip(numbers, chosen, strict=True)]

    return folds.per_run(found, fold, IMAGES, ["unit_no", "place"])


def image_groups(found: DataFrame, o: folds.Images = folds.Images()) -> DataFrame:  # noqa: B008  not changed
    """A row for each dropped or kept member of a run's image groups: group_no, kind, id, t, kept, reason, review_required."""
    schema = "run_id long, group_no long, kind string, id long, t double, kept boolean, reason string, review_required boolean"

    def fold(rows: list[dict]) -> list[dict]:
        unique: dict = {}
        for row in rows:
            unique.setdefault(row["id"], row)
        out = []
        for k, (kind, members) in enumerate(folds.image_groups(sorted(unique.values(), key=lambda f: f["t"]), o), 1):
            best = folds.best_image(members, o)["id"]
            out += [{"group_no": k, "kind": kind, "id": f["id"], "t": f["t"], "kept": f["id"] == best, "reason": None if f["id"] == best else f"{kind}_keep_one_representative", "review_required": kind == "rapid_visual_burst"} for f in members]
        return out

    return folds.per_run(found, fold, schema, ["unit_no", "place"])


def review_points(held: DataFrame) -> DataFrame:
    """Units by what calls for review. held: unit_no, chars, n_visuals, n_candidates, n_selected; a unit may have several points."""
    rules = [
        ("no_selected_image", F.col("n_selected") == 0),
        ("too_many_candidates", F.col("n_candidates") > 2),
        ("long_text_little_visual", (F.col("chars") > 1800) & (F.col("n_visuals") <= 1)),
        ("visual_change_little_text", (F.col("n_visuals") > 1) & (F.col("chars") < 160)),
    ]
    points = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return held.withColumn("points", points)


def requests(held: DataFrame, each: int = 800, whole: int = 6000, max_output_tokens: int = 1200, language: str = "zh-CN") -> DataFrame:
    """A request for each unit with excerpts, selected and warnings: the unit's evidence within a budget of characters, and the rules for its use."""
    texts = budgets.within_budget(F.transform("excerpts", lambda x: x["text"]), each, whole)
    fitted = F.transform(F.arrays_zip(F.slice("excerpts", 1, F.greatest(F.size(texts), F.lit(0))).alias("x"), texts.alias("t")), lambda z: z["x"].withField("text", z["t"]))
    unit_id = F.format_string("unit_%03d", "unit_no")
    return held.select(
        "run_id",
        F.lit(REQUEST_SCHEMA).alias("schema_version"),
        unit_id.alias("unit_id"),
        F.struct(F.round("s", 3).alias("start_time"), F.round("e", 3).alias("end_time")).alias("time_range"),
        fitted.alias("transcript_excerpts"),
        F.transform("items", lambda x: x["seg_id"]).alias("transcript_item_ids"),
        F.col("visuals").alias("visual_segment_ids"),
        F.col("selected").alias("selected_keyframe"),
        "warnings",
        F.struct(F.lit(language).alias("output_language"), F.lit("structured_json").alias("format"), F.lit("course learner").alias("audience"), F.lit(max_output_tokens).alias("max_output_tokens")).alias("style_constraints"),
        F.array(*[F.lit(rule) for rule in GROUNDING_RULES]).alias("grounding_rules"),
    )


def pack_descriptor(held: DataFrame, path: str, generated: bool) -> DataFrame:
    """(run_id, generated, path, item_count, ...) of each run's prompt pack; no items where none is generated."""
    counted = held.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    no = F.lit(False)
    return counted.select(
        "run_id", F.lit(generated).alias("generated"), F.lit(path).alias("path"), (F.col("n") if generated else F.lit(0).cast("long")).alias("item_count"),
        F.lit(REQUEST_SCHEMA).alias("schema_version"), no.alias("contains_full_raw_transcript"), no.alias("contains_secrets"), no.alias("network_calls"),
    )


def validation_summary(held: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts of each run's map. held: unit_no, s, group_no, selected, dropped, review_required; groups: from image_groups()."""
    from pyspark.sql import Window

    falls = F.col("s") < F.lag("s").over(Window.partitionBy("run_id").orderBy("unit_no"))
    counted = held.withColumn("falls", F.coalesce(falls, F.lit(False))).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("content_unit_count"), F.count_distinct("group_no").alias("topic_group_count"), (~F.bool_or("falls")).alias("units_monotonic_by_time"),
        F.count("selected").alias("selected_keyframe_count"), F.sum(F.size("dropped")).alias("dropped_keyframe_count"), F.count_if("review_required").alias("review_required_unit_count"),
    )
    n = groups.groupBy("run_id").agg(F.count_distinct("group_no").alias("n"))
    return counted.join(n, "run_id", "left").select(*counted.columns, F.coalesce("n", F.lit(0)).alias("near_duplicate_image_group_count"))


def topic_groups(held: DataFrame, longest: float = 720.0, most: int = 4) -> DataFrame:
    """group_no of each (run_id, unit_no): four units at most, within twelve minutes of the group's start."""
    rows = held.select("run_id", "unit_no", "s", "e")
    return chains.chunked(rows, ["run_id"], longest, most, ("unit_no", "s", "e")).select("run_id", "unit_no", F.col("chunk").alias("group_no"))


# Fixed values of the format: what a review report says
REVIEW_TITLE = "# Review Report"
REVIEW_NOTICE = "> This report is machine-generated engineering review material. It is not human-approved."
REVIEW_POINTS = (
    ("no_selected_image", "Units without selected image"),
    ("too_many_candidates", "Units with too many image candidates"),
    ("long_text_little_visual", "Long transcript with little visual change"),
    ("visual_change_little_text", "Visual change with little transcript"),
)
CHECKLIST = (
    "Check whether content units are too fragmented or too coarse.",
    "Check whether each selected screenshot supports the nearby transcript excerpts.",
    "Review near-duplicate groups and confirm that useful teaching states were not hidden.",
    "Review units without selected images and decide whether another representative is needed.",
    "Confirm that the handout skeleton is not mistaken for final polished notes.",
)
NEXT_STEP = "Run an independent review and a human spot-check before proceeding to any model-backed generation stage."


def _noted(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: `"), F.coalesce(value.cast("string"), F.lit("none")), F.lit("`"))


def _bullets(items: Column, none: str) -> Column:
    """An array of lines as one text, or what is said where there are none."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, none).otherwise(F.array_join(items, "\n"))


def review_report(held: DataFrame, groups: DataFrame | None = None, health: DataFrame | None = None, hashes: DataFrame | None = None, packs: DataFrame | None = None, known_issues: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(run_id, markdown): what a reviewer should look at.

    held: unit_no, group_no, s, e, points, selected, dropped (id, t, reason), n_candidates; groups: from image_groups(); health: run_id and
    columns that are listed by name; hashes: run_id, source, hash; packs: from pack_descriptor(). A part that is not given is left out."""
    unit_id = F.format_string("unit_%03d", "unit_no")
    has = set(held.columns)
    many = F.col("n_candidates") > 2 if "n_candidates" in has else F.array_contains("points", "too_many_candidates")
    topic = F.col("group_no") if "group_no" in has else F.lit(None).cast("long")
    rows = held.select("run_id", "unit_no", unit_id.alias("u"), "s", "e", "points", F.col("selected").isNotNull().alias("has"), "dropped", many.alias("many"), topic.alias("topic"))
    run = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"), F.count_if("has").alias("n_selected"), F.sum(F.size("dropped")).alias("n_dropped"), F.count_if("many").alias("n_many"), F.count_distinct("topic").alias("n_topics"),
        F.array_sort(F.collect_list(F.struct("unit_no", "u", "points", "dropped"))).alias("l"),
    )

    def named(point: str) -> Column:
        found = F.filter("l", lambda x: F.array_contains(x["points"], point))
        return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: x["u"]), ", "))

    dropped = F.flatten(F.transform("l", lambda x: F.transform(x["dropped"], lambda d: F.concat(F.lit("- `"), x["u"], F.lit("`: `"), d["id"].cast("string"), F.lit("` - `"), d["reason"], F.lit("`")))))
    blank = F.lit("")
    head = [F.lit(REVIEW_TITLE), blank, F.lit(REVIEW_NOTICE), blank]
    counts = [("Run ID", "run_id"), ("Content units", "n"), ("Topic groups", "n_topics"), ("Selected handout images", "n_selected"), ("Dropped handout-level candidates", "n_dropped")]
    lines = [*head, F.lit("## Artifact Summary"), blank, *[_noted(label, F.col(c)) for label, c in counts], blank]
    if health is not None:
        names = [c for c in health.columns if c != "run_id"]
        run = run.join(health.select("run_id", F.array(*[F.concat(F.lit(f"- `{c}`: `"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit("`")) for c in names]).alias("health")), "run_id", "left")
        lines += [F.lit("## Input Artifact Health"), blank, _bullets(F.col("health"), "- Not known."), blank]
    if hashes is not None:
        each = hashes.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", F.col("hash").cast("string").alias("h")))), lambda x: F.concat(F.lit("- `"), x["source"], F.lit("`: `"), x["h"], F.lit("`"))).alias("hashes"))
        run = run.join(each, "run_id", "left")
        lines += [F.lit("## Source Hashes"), blank, _bullets(F.col("hashes"), "- Not known."), blank]
    lines += [F.lit("## Time Coverage"), blank, _noted("Start", T.format_timestamp(F.col("s"))), _noted("End", T.format_timestamp(F.col("e"))), blank]
    if groups is not None:
        kept, gone = F.max(F.when(F.col("kept"), F.col("id"))), F.count_if(~F.col("kept"))
        each = groups.groupBy("run_id", "group_no", "kind").agg(kept.alias("kept"), gone.alias("gone"))
        text = F.concat(F.lit("- `"), F.format_string("image_group_%03d", "group_no"), F.lit("` `"), F.col("kind"), F.lit("`: keep `"), F.col("kept").cast("string"), F.lit("`; dropped `"), F.col("gone").cast("string"), F.lit("` candidate(s)."))
        each = each.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_no", text.alias("text")))), lambda x: x["text"]).alias("groups"))
        run = run.join(each, "run_id", "left")
        n_groups = F.coalesce(F.size("groups"), F.lit(0))
        lines += [F.lit("## Image Selection Summary"), blank, _noted("Near-duplicate or density-control groups", F.when(n_groups < 0, 0).otherwise(n_groups)), _noted("Units without a selected image", F.col("n") - F.col("n_selected")), _noted("Units with more than two candidate images", F.col("n_many")), blank]
        lines += [F.lit("## Near-Duplicate Image Groups"), blank, _bullets(F.col("groups"), "- None detected."), blank]
    lines += [F.lit("## Dropped Candidate Keyframes"), blank, _bullets(dropped, "- None."), blank]
    lines += [F.lit("## Automated Review Points"), blank, *[_noted(label, named(point)) for point, label in REVIEW_POINTS], blank]
    lines += [F.lit("## Known Issues"), blank, *([F.lit(f"- {issue}") for issue in known_issues] or [F.lit("- No operator-supplied known issues.")]), blank]
    if packs is not None:
        run = run.join(packs.select("run_id", "generated", "path", "item_count", "schema_version"), "run_id", "left")
        lines += [F.lit("## Prompt Pack Summary"), blank, *[_noted(label, F.col(c)) for label, c in (("Generated", "generated"), ("Path", "path"), ("Item count", "item_count"), ("Schema", "schema_version"))], blank]
    lines += [F.lit("## Human Review Checklist"), blank, *[F.lit(f"- {item}") for item in CHECKLIST], blank, F.lit("## Next-Step Recommendation"), blank, F.lit(NEXT_STEP)]
    return run.select("run_id", F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n")).alias("markdown"))
