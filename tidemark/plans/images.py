"""Queries on frames: features, quality, differences, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import areas as A
from ..functions import vectors as V
from ..operators import frames
from . import inputs
from .inputs import SQL

SIDE = 8


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.frames(spark, sf_dir)
    return rows.select("vec_id", "px", F.round(V.mean(F.col("px")), 6).alias("mean"), F.round(V.variance(F.col("px")), 6).alias("variance"), F.round(V.sharpness(F.col("px"), SIDE, SIDE), 6).alias("sharpness"))


def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a frame is rejected, if it is; thresholds are scaled to these images."""
    m = measures(spark, sf_dir)
    mean, variance = F.col("mean"), F.col("variance")
    rules = [("dark_frame", (mean <= 126) & (variance <= 1000)), ("bright_frame", (mean >= 130) & (variance <= 1000)), ("near_solid_frame", variance <= 800), ("low_variance", variance < 900), ("low_sharpness", F.col("sharpness") < 34)]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return m.select("vec_id", "mean", "variance", "sharpness", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


_QUALITY = f"""{SQL},
st AS (SELECT vec_id, px, list_sum(px) AS t, len(px) AS n, list_sum(list_transform(px, lambda x: x * x)) AS q,
       list_transform(range(1, len(px) + 1), lambda i: CASE WHEN i % 8 <> 0 AND i < 64 THEN abs(px[i] - px[i + 1]) END) AS r, list_transform(range(1, len(px) + 1), lambda i: CASE WHEN i <= 56 THEN abs(px[i] - px[i + 8]) END) AS d FROM fr),
me AS (SELECT vec_id, px, round(t / CAST(n AS DOUBLE), 6) AS mean, round((n * q - t * t) / CAST(n * n AS DOUBLE), 6) AS variance,
       round((coalesce(list_sum(r), 0) + coalesce(list_sum(d), 0)) / CAST(len(list_filter(r, lambda x: x IS NOT NULL)) + len(list_filter(d, lambda x: x IS NOT NULL)) AS DOUBLE), 6) AS sharpness FROM st),
qr AS (SELECT vec_id, mean, variance, sharpness, list_filter([CASE WHEN mean <= 126 AND variance <= 1000 THEN 'dark_frame' END, CASE WHEN mean >= 130 AND variance <= 1000 THEN 'bright_frame' END, CASE WHEN variance <= 800 THEN 'near_solid_frame' END, CASE WHEN variance < 900 THEN 'low_variance' END, CASE WHEN sharpness < 34 THEN 'low_sharpness' END], lambda x: x IS NOT NULL) AS reasons FROM me)
"""


def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by reason, and the accepted ones."""
    rows = quality_reasons(spark, sf_dir).select(F.explode(F.split(F.when(F.col("reasons") == "", "accepted").otherwise(F.col("reasons")), ",")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """Frames with the one of the next id: an equi-join on shifted ids, no window without a key."""
    rows = inputs.frames(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in columns.items()])
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(n).alias(f"{n}_b") for n in columns])
    return rows.join(after, "vec_id")


def histogram_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, h=V.normalized(V.histogram(F.col("px"), 8, 32)))
    return rows.select("vec_id", F.round(V.histogram_difference(F.col("h"), F.col("h_b")), 6).alias("difference"))


def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, h=V.average_hash(F.col("px")))
    return rows.select("vec_id", F.round(V.hash_difference(F.col("h"), F.col("h_b"), 0.0), 6).alias("frame_difference"), F.round(V.hash_difference(F.col("h"), F.slice("h_b", 1, 32), 1.0), 6).alias("unequal_difference"))


def region_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.frames(spark, sf_dir)
    return rows.select("vec_id", F.round(V.area_ratio(F.col("px"), 110), 6).alias("content_area_ratio"), F.round(V.detail_density(F.col("px"), SIDE, SIDE, 40), 6).alias("detail_density"), F.round(V.layout_richness(F.col("px"), SIDE, SIDE, 110, 4), 6).alias("layout_richness"))


_REGION = f"""{_QUALITY},
ce AS (SELECT vec_id, unnest(range(0, 16)) AS c, px FROM fr),
ly AS (SELECT vec_id, count(*) FILTER (WHERE len(list_filter([px[b], px[b + 1], px[b + 8], px[b + 9]], lambda x: x < 110)) > 0.32) / 16.0 AS layout FROM (SELECT vec_id, px, 1 + (c // 4) * 16 + (c % 4) * 2 AS b FROM ce) x GROUP BY vec_id),
rm AS (SELECT st.vec_id, round(len(list_filter(px, lambda x: x < 110)) / CAST(n AS DOUBLE), 6) AS content_area_ratio,
       round((len(list_filter(r, lambda x: x > 40)) + len(list_filter(d, lambda x: x > 40))) / 112.0, 6) AS detail_density, round(CAST(layout AS DOUBLE), 6) AS layout_richness FROM st JOIN ly ON st.vec_id = ly.vec_id)
"""


def scored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual segments with the features of the image that each shows, of the whole table, and their score by position in the run."""
    seen = inputs.visual(spark, sf_dir).select("run_id", "seg_id", "s")
    rows = inputs.shown(seen, inputs.placed_frames(spark, sf_dir, region_metrics(spark, sf_dir)))
    run = Window.partitionBy("run_id")
    low, high = F.min("s").over(run), F.max("s").over(run)
    position = F.coalesce((F.col("s") - low) / F.nullif(high - low, F.lit(0)), F.lit(0.0))
    return rows.withColumn("score", V.fuller_score(F.col("content_area_ratio"), F.col("detail_density"), F.col("layout_richness"), position))


def fuller_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fullest frames of each run; the later of equals first. The rank limit has a map-side part."""
    order = Window.partitionBy("run_id").orderBy(F.col("score").desc(), F.col("s").desc(), F.col("seg_id").desc())
    rows = scored_frames(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    return rows.select("run_id", "rank", "seg_id", "score")


def low_content_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_frames(spark, sf_dir)
    flag = (F.col("content_area_ratio") <= 0.3) & (F.col("detail_density") <= 0.5) & (F.col("layout_richness") <= 0.8)
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(flag).alias("n_low"), F.min(F.when(flag, F.struct("s", "seg_id"))).alias("f")).select("run_id", "n_frames", "n_low", F.col("f.seg_id").alias("first_low"))


def resolution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = inputs.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 30).cast("long").alias("height"))
    h = F.col("height")
    status = F.when(h.isNull(), "unknown").when(h >= 1080, "success").when(h >= 720, "degraded").otherwise("failed")
    lenient = F.when(h.isNull(), "unknown").when(h >= 1080, "success").otherwise("degraded")
    keyframe = F.when(h.isNull(), "unknown").when(h >= 720, "success").otherwise("failed")
    return part.select("p_partkey", "height", F.concat(F.floor(h * 16 / 9).cast("string"), F.lit("x"), h.cast("string")).alias("resolution"), status.alias("strict_status"), lenient.alias("status"), keyframe.alias("keyframe_status"))


def crop_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison regions: centered by percent, manual by bounds, anything invalid the full frame with a warning."""
    part = inputs.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).cast("long").alias("width"), (F.col("p_size") * 9).cast("long").alias("height"), (F.col("p_partkey") % 3).alias("mode"), ((F.col("p_partkey") % 13) / 10).alias("pct"))
    center = (F.col("mode") == 1) & (F.col("pct") > 0) & (F.col("pct") <= 1)
    left, right = F.col("pct") / 2, F.col("pct")
    manual = (F.col("mode") == 2) & (left < right) & (right <= 1)
    w, h = F.floor(F.col("width") * F.col("pct")), F.floor(F.col("height") * F.col("pct"))
    x = F.when(center, F.floor((F.col("width") - w) / 2)).when(manual, F.floor(F.col("width") * left)).otherwise(0)
    y = F.when(center, F.floor((F.col("height") - h) / 2)).otherwise(0)
    x2 = F.when(center, x + w).when(manual, F.floor(F.col("width") * right)).otherwise(F.col("width"))
    y2 = F.when(center, y + h).otherwise(F.col("height"))
    kind = F.when(center, "center_crop").when(manual, "manual").otherwise("full_frame")
    return part.select("p_partkey", *[c.cast("long").alias(n) for n, c in (("x", x), ("y", y), ("x2", x2), ("y2", y2))], kind.alias("kind"), ((F.col("mode") != 0) & (kind == "full_frame")).alias("warned"))


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, A.Box, A.Box]:
    """All images with their summed-area tables, at thresholds that fit these images, and the boxes of slide and title."""
    rows = inputs.frames(spark, sf_dir).withColumns({"width": F.lit(SIDE), "height": F.lit(SIDE)})
    w, h = F.col("width"), F.col("height")
    return frames.tables(rows, ink=110, step=40), A.box(w, h, *frames.SLIDE_BOX), A.box(w, h, *frames.TITLE_BOX)


def region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content, detail and layout, mean and variance of each image's slide box."""
    held, slide, _ = _regions(spark, sf_dir)
    w = F.col("width")
    found = {**frames.measured(held, slide), "mean": A.box_mean(F.col("sums"), w, slide), "variance": A.box_variance(F.col("sums"), F.col("squares"), w, slide)}
    return held.select("vec_id", *[F.round(c, 6).alias(name) for name, c in found.items()])


def title_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled hash of each image's title box, and its difference from that of the next image."""
    held, _, title = _regions(spark, sf_dir)
    rows = held.select("vec_id", A.box_hash(F.col("sums"), F.col("width"), *title).alias("h"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("h_b"))
    return rows.join(after, "vec_id").select("vec_id", F.array_join("h", "").alias("title_hash"), F.round(V.hash_difference(F.col("h"), F.col("h_b"), 1.0), 6).alias("difference"))


QUERIES = {f.__name__: f for f in (region_features, title_hashes, quality_reasons, quality_histogram, histogram_distance, hash_distance, region_metrics, fuller_score_topk, low_content_flags, resolution_status, crop_region)}

_SCORED = f"""{_REGION},
sf AS (SELECT run_id, seg_id, s, rm.*, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / CAST(max(s) OVER w - min(s) OVER w AS DOUBLE) ELSE 0 END AS position FROM vi JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM rm) rm ON vi.seg_id % (SELECT count(DISTINCT vec_id) FROM fr) = rm.place WINDOW w AS (PARTITION BY run_id)),
sc AS (SELECT *, round(0.45 * content_area_ratio + 0.25 * detail_density + 0.30 * layout_richness + 0.08 * greatest(0, least(1, position)), 6) AS score FROM sf)
"""

ORACLE_SQL = {
    "quality_reasons": f"WITH {_QUALITY} SELECT vec_id, mean, variance, sharpness, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM qr",
    "quality_histogram": f"WITH {_QUALITY} SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['accepted'] ELSE reasons END) AS reason FROM qr) x GROUP BY reason",
    "histogram_distance": f"""WITH {SQL}, h AS (SELECT vec_id, list_transform(range(0, 8), lambda b: len(list_filter(px, lambda x: x // 32 = b)) / CAST(len(px) AS DOUBLE)) AS h FROM fr)
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.h, b.h), lambda z: abs(z[1] - z[2]))) / 2, 6) AS difference FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""",
    "hash_distance": f"""WITH {SQL}, h AS (SELECT vec_id, list_transform(px, lambda x: CAST(x * len(px) > list_sum(px) AS INTEGER)) AS h FROM fr)
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.h, b.h), lambda z: abs(z[1] - z[2]))) / 64.0, 6) AS frame_difference, CAST(1.0 AS DOUBLE) AS unequal_difference FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""",
    "region_metrics": f"WITH {_REGION} SELECT * FROM rm",
    "fuller_score_topk": f"WITH {_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, s DESC, seg_id DESC) AS rank FROM sc) SELECT run_id, CAST(rank AS INTEGER) AS rank, seg_id, score FROM o WHERE rank <= 2",
    "low_content_flags": f"WITH {_SCORED}, l AS (SELECT *, content_area_ratio <= 0.3 AND detail_density <= 0.5 AND layout_richness <= 0.8 AS low FROM sc) SELECT run_id, count(*) AS n_frames, count(*) FILTER (WHERE low) AS n_low, arg_min(seg_id, s * 100000000 + seg_id) FILTER (WHERE low) AS first_low FROM l GROUP BY run_id",
    "resolution_status": """WITH h AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size * 30 AS BIGINT) END AS height FROM part)
SELECT p_partkey, height, CAST(height * 16 // 9 AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS resolution, CASE WHEN height IS NULL THEN 'unknown' WHEN height >= 1080 THEN 'success' WHEN height >= 720 THEN 'degraded' ELSE 'failed' END AS strict_status,
CASE WHEN height IS NULL THEN 'unknown' WHEN height >= 1080 THEN 'success' ELSE 'degraded' END AS status, CASE WHEN height IS NULL THEN 'unknown' WHEN height >= 720 THEN 'success' ELSE 'failed' END AS keyframe_status FROM h""",
    "crop_region": """WITH p AS (SELECT p_partkey, CAST(p_size * 16 AS BIGINT) AS width, CAST(p_size * 9 AS BIGINT) AS height, p_partkey % 3 AS mode, (p_partkey % 13) / CAST(10 AS DOUBLE) AS pct FROM part),
k AS (SELECT *, CAST(floor(width * pct) AS BIGINT) AS w, CAST(floor(height * pct) AS BIGINT) AS h, CASE WHEN mode = 1 AND pct > 0 AND pct <= 1 THEN 'center_crop' WHEN mode = 2 AND pct / 2 < pct AND pct <= 1 THEN 'manual' ELSE 'full_frame' END AS kind FROM p)
SELECT p_partkey, kind, mode <> 0 AND kind = 'full_frame' AS warned, CASE kind WHEN 'center_crop' THEN (width - w) // 2 WHEN 'manual' THEN CAST(floor(width * (pct / 2)) AS BIGINT) ELSE 0 END AS x, CASE kind WHEN 'center_crop' THEN (height - h) // 2 ELSE 0 END AS y,
CASE kind WHEN 'center_crop' THEN (width - w) // 2 + w WHEN 'manual' THEN w ELSE width END AS x2, CASE kind WHEN 'center_crop' THEN (height - h) // 2 + h ELSE height END AS y2 FROM k""",
    "region_features": f"""WITH {SQL}, b AS (SELECT vec_id, px, list_transform(range(48), lambda i: px[(i // 6) * 8 + i % 6 + 1]) AS v FROM fr),
d AS (SELECT *, list_filter(range(48), lambda i: i % 6 < 5 AND abs(v[i + 1] - v[i + 2]) > 40) AS r, list_filter(range(42), lambda i: abs(v[i + 1] - v[i + 7]) > 40) AS c, list_sum(v) AS t, list_sum(list_transform(v, lambda x: x * x)) AS q FROM b)
SELECT vec_id, round(len(list_filter(v, lambda x: x < 110)) / 48.0, 6) AS content, round((len(r) + len(c)) / 82.0, 6) AS detail,
round(len(list_filter(range(16), lambda i: px[(i // 4) * 16 + i % 4 + 1] < 110 OR px[(i // 4) * 16 + i % 4 + 9] < 110)) / 16.0, 6) AS layout, round(t / 48.0, 6) AS mean, round((48 * q - t * t) / 2304.0, 6) AS variance FROM d""",
    "title_hashes": f"""WITH {SQL}, b AS (SELECT vec_id, list_transform(range(64), lambda i: px[(i // 32) * 8 + [0, 0, 1, 2, 3, 3, 4, 5][i % 8 + 1] + 1]) AS v FROM fr),
h AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN 64 * x > list_sum(v) THEN 1 ELSE 0 END) AS h FROM b)
SELECT x.vec_id, array_to_string(x.h, '') AS title_hash, round(len(list_filter(range(1, 65), lambda i: x.h[i] <> y.h[i])) / 64.0, 6) AS difference FROM h x JOIN h y ON y.vec_id = x.vec_id + 1""",
}
