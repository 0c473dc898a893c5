"""Text segments of a run without what their neighbours have shown already: folds in the JVM over one run's sorted array.

rows: run_id, seg_id, text (a null counts as empty). State restarts with every run; ties in seg_id go by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .budgets import added, grown, listed


def _runs(rows: DataFrame) -> DataFrame:
    held = rows.select("run_id", "seg_id", F.coalesce("text", F.lit("")).alias("text"))
    return held.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("l"))


def rolling(rows: DataFrame) -> DataFrame:
    """Cues without the lines that the last cue with text has shown; cues that become empty go."""

    def lines(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, "\n"), T.norm_ws), lambda y: y != "")

    held = _runs(rows).withColumn("l", F.transform("l", lambda x: F.struct(x["seg_id"].alias("seg_id"), lines(x["text"]).alias("lines"))))
    kind = f"struct<seg_id:{dict(rows.dtypes)['seg_id']},text:string>"
    state = F.struct(F.lit("").alias("last"), grown(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = F.array_join(F.filter(x["lines"], lambda y: ~F.contains(s["last"], F.lower(y))), " ")
        out = added(s["out"], F.struct(x["seg_id"].alias("seg_id"), new.alias("text")))
        return F.when(new == "", s).otherwise(F.struct(F.lower(new).alias("last"), out.alias("out")))

    found = held.select("run_id", F.explode(F.aggregate("l", state, step, lambda s: listed(s["out"]))).alias("x"))
    return found.select("run_id", "x.seg_id", "x.text")


def without_redundant(rows: DataFrame) -> DataFrame:
    """Segments that no neighbour of the input holds; of one that holds the last kept one, or is held by it, the longer stays. Numbered anew, from 1."""
    run = _runs(rows)
    plain = F.transform("l", lambda x: F.lower(T.norm_ws(x["text"])))
    run = run.withColumn("p", plain)

    def part(a: Column, b: Column) -> Column:
        return (a != "") & F.contains(b, a)

    p = F.col("p")
    before = lambda i: F.when(i > 0, F.get(p, i - 1)).otherwise("")
    after = lambda i: F.coalesce(F.get(p, i + 1), F.lit(""))
    skip = lambda i: part(F.get(p, i), before(i)) | part(F.get(p, i), after(i))
    kept = F.transform("l", lambda x, i: F.struct(x["seg_id"].alias("seg_id"), x["text"].alias("text"), F.get(p, i).alias("p"), skip(i).alias("skip")))
    held = run.withColumn("k", F.filter(kept, lambda x: ~x["skip"]))
    one = f"struct<seg_id:{dict(rows.dtypes)['seg_id']},text:string,p:string>"
    state = F.struct(F.lit(None).cast(one).alias("last"), grown(one).alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = F.struct(x["seg_id"].alias("seg_id"), x["text"].alias("text"), x["p"].alias("p"))
        meets = s["last"].isNotNull() & (part(x["p"], s["last"]["p"]) | part(s["last"]["p"], x["p"]))
        longer = F.char_length(x["text"]) > F.char_length(s["last"]["text"])
        done = F.when(s["last"].isNull(), s["out"]).otherwise(added(s["out"], s["last"]))
        return F.when(meets & longer, F.struct(new.alias("last"), s["out"].alias("out"))).when(meets, s).otherwise(F.struct(new.alias("last"), done.alias("out")))

    whole = F.aggregate("k", state, step, lambda s: F.when(s["last"].isNull(), listed(s["out"])).otherwise(F.concat(listed(s["out"]), F.array(s["last"]))))
    found = held.select("run_id", F.posexplode(whole).alias("number", "x"))
    return found.select("run_id", (F.col("number") + 1).cast("long").alias("number"), "x.seg_id", "x.text")
