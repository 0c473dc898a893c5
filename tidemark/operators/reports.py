"""Markdown outlines of content units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def outline(units: DataFrame) -> DataFrame:
    """(run_id, markdown) of units (run_id, unit_no, group_no, s, e, summary, image): a heading a group, an entry a unit, in order."""
    span = F.concat(T.format_timestamp(F.col("s")), F.lit(" - "), T.format_timestamp(F.col("e")))
    image = F.coalesce(F.concat(F.lit("\n\n!["), F.format_string("unit %03d", "unit_no"), F.lit("]("), T.image_path(F.col("image")), F.lit(")")), F.lit(""))
    entry = F.concat(F.lit("### "), F.format_string("Unit %03d", "unit_no"), F.lit(" ("), span, F.lit(")\n\n"), F.coalesce("summary", F.lit("")), image)
    groups = units.select("run_id", "group_no", "unit_no", entry.alias("entry")).groupBy("run_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("unit_no", "entry"))).alias("l"))
    text = F.concat(F.format_string("## Topic %03d", "group_no"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["entry"]), "\n\n"))
    whole = groups.select("run_id", "group_no", text.alias("text")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("group_no", "text"))).alias("l"))
    return whole.select("run_id", F.concat(F.array_join(F.transform("l", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown"))


# Fixed values of the format: what a handout skeleton says
HANDOUT_TITLE, HANDOUT_NOTICE = "# 课程讲义骨架：", "> 本文件是机器生成的讲义骨架草稿，尚未经过人工审核，也不是最终润色后的课程讲义。"
OVERVIEW_HEADING, RUN_LABEL, LANGUAGE_LABEL = "## 课程概览", "运行标识", "原始字幕语言"
OVERVIEW_SOURCE = "- 内容来源：公开视频字幕与视频关键截图。"
OVERVIEW_NOTES = ("- 当前版本用于核对内容结构、时间范围和代表截图。", "- 字幕摘录保留原始语言，后续需要基于可追溯证据整理为自然中文讲义。")
GROUP_LABEL, UNIT_LABEL, SPAN_LABEL, IMAGE_LABEL = "章节", "教学单元", "时间范围", "代表截图"
UNIT_STATE, EXCERPTS_HEADING = "- 当前状态：待后续内容整理与人工复核。", "字幕摘录（原文，供后续整理）："
CLOSING = ("## 后续整理说明", "当前文件仅提供可追溯的章节骨架、截图和有限字幕摘录。自然中文表达、概念归并和示例整理将在后续阶段完成。")


def handout(units: DataFrame, runs: DataFrame, timestamps: bool = True, notice: bool = True) -> DataFrame:
    """(run_id, markdown): the handout's skeleton of each run: header, overview, and by topic group each unit's time, image and up to three excerpts.

    units: run_id, unit_no, group_no, s, e, image, excerpts (text and others); runs: run_id, language (of the transcript)."""
    hint = F.format_string(f"{UNIT_LABEL} %03d", "unit_no")
    span = F.concat(F.lit(f"- {SPAN_LABEL}："), T.format_timestamp(F.col("s")), F.lit(" - "), T.format_timestamp(F.col("e")))
    image = F.concat(F.lit("!["), hint, F.lit(f" {IMAGE_LABEL}]("), T.image_path(F.col("image")), F.lit(")\n"))
    excerpts = F.transform(F.slice("excerpts", 1, 3), lambda x: F.concat(F.lit("- "), x["text"]))
    parts = [F.concat(F.lit("### "), hint, F.lit("\n")), *([span] if timestamps else []), F.lit(f"{UNIT_STATE}\n"), image, F.lit(f"{EXCERPTS_HEADING}\n"), F.concat(F.array_join(excerpts, "\n"), F.lit("\n"))]
    entry = F.array_join(F.array_compact(F.array(*parts)), "\n")
    groups = units.select("run_id", "group_no", "unit_no", entry.alias("entry")).groupBy("run_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("unit_no", "entry"))).alias("l"))
    text = F.concat(F.format_string(f"## {GROUP_LABEL} %03d", "group_no"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["entry"]), "\n"))
    whole = groups.select("run_id", "group_no", text.alias("text")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("group_no", "text"))).alias("l"))
    whole = whole.join(runs.select("run_id", "language"), "run_id", "left")
    run = F.col("run_id").cast("string")
    lines = [
        F.concat(F.lit(HANDOUT_TITLE), run, F.lit("\n")), *([F.lit(f"{HANDOUT_NOTICE}\n")] if notice else []), F.lit(f"{OVERVIEW_HEADING}\n"), F.concat(F.lit(f"- {RUN_LABEL}：`"), run, F.lit("`")), F.lit(OVERVIEW_SOURCE),
        F.concat(F.lit(f"- {LANGUAGE_LABEL}：`"), F.coalesce("language", F.lit("")), F.lit("`")), *[F.lit(x) for x in OVERVIEW_NOTES[:-1]], F.lit(OVERVIEW_NOTES[-1] + "\n"), F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit(f"{CLOSING[0]}\n"), F.lit(CLOSING[1]),
    ]
    return whole.select("run_id", F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n")).alias("markdown"))


def summary(units: DataFrame) -> DataFrame:
    """Units, groups, images and whether starts rise, for each run."""
    from pyspark.sql import Window

    falls = F.col("s") < F.lag("s").over(Window.partitionBy("run_id").orderBy("unit_no"))
    marked = units.withColumn("falls", F.coalesce(falls, F.lit(False)))
    return marked.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_units"), F.count_distinct("group_no").alias("n_groups"), F.count("image").alias("n_images"), (~F.bool_or("falls")).alias("monotonic"))
