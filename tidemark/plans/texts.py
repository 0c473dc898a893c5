"""Queries on texts and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks
from .inputs import table


def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' text, all entities decoded, by hash."""
    plain = T.strip_markup(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(plain, 256).alias("text_sha"), T.image_path(F.col("url")).alias("image_path"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seg_id"), "role", F.coalesce("text", F.lit("")).alias("text"))


def contains_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn is found, whole, in the turn before or after it."""
    order = Window.partitionBy("run_id").orderBy("seg_id")
    rows = turns(spark, sf_dir).withColumns({"before": F.lag("text").over(order), "after": F.lead("text").over(order)})
    held = {name: F.coalesce(T.contained(F.col("text"), F.col(name)), F.lit(False)).alias(f"in_{name}") for name in ("before", "after")}
    return rows.select("run_id", "seg_id", *held.values())


def redundant_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whole in a neighbour; two that hold each other are both redundant."""
    order = Window.partitionBy("run_id").orderBy("seg_id")
    rows = turns(spark, sf_dir).withColumns({"before": F.coalesce(F.lag("text").over(order), F.lit("")), "after": F.coalesce(F.lead("text").over(order), F.lit(""))})
    redundant = T.contained(F.col("text"), F.col("before")) | T.contained(F.col("text"), F.col("after"))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(redundant).alias("n_redundant"))


def clip_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last turn of a conversation, clipped."""
    run = Window.partitionBy("run_id")
    rows = turns(spark, sf_dir).withColumns({"k": F.row_number().over(run.orderBy("seg_id")), "n": F.count(F.lit(1)).over(run)})
    rows = rows.where((F.col("n") <= 3) | F.col("k").isin(1) | (F.col("k") == F.floor(F.col("n") / 2) + 1) | (F.col("k") == F.col("n")))
    return rows.select("run_id", "seg_id", T.clip(F.col("text"), 60).alias("excerpt"), T.cut(F.col("text"), 12).alias("cut"), T.title_hint(F.col("text"), 40).alias("hint"))


def transcript_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    return rows.groupBy("run_id").agg(F.min("seg_id").alias("first_turn"), F.max("seg_id").alias("last_turn"), F.sum(F.char_length("text")).alias("n_chars"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def artifact_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


def subtitle_language_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the best of its languages: platform before automatic, exact before prefixed, then by preference and name.

    Candidates meet preferences through a list of four; the winner is a minimum with a map-side part."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    kind = F.when(F.col("doc_id") % 2 == 0, 0).otherwise(2)
    language = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.concat(F.col("lang"), F.lit("-"), (F.col("doc_id") % 5).cast("string")))
    rows = docs.select("source", kind.alias("kind"), language.alias("language"))
    prefs = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(p).alias("pref")) for k, p in enumerate(("es", "de", "fr", "en"))])
    pairs = rows.select("source", "kind", "language", F.explode(prefs).alias("p"))
    exact = F.col("language") == F.col("p.pref")
    pairs = pairs.where(exact | F.startswith("language", F.concat(F.col("p.pref"), F.lit("-")))).withColumn("tier", F.col("kind") + F.when(exact, 0).otherwise(1))
    best = pairs.groupBy("source").agg(F.min(F.struct("tier", F.col("p.pos").alias("pos"), "language")).alias("b"))
    return best.select("source", F.col("b.tier").cast("long").alias("tier"), F.col("b.language").alias("language"))


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key has no partner, of four references; a document's labels and an order's customer among them."""
    t = lambda name: table(spark, sf_dir, name)
    found = checks.missing(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders_customer", "o_orderkey")
    found = found.unionByName(checks.missing(t("customer"), "c_custkey", t("orders"), "o_custkey", "customer_orders", "c_custkey"))
    found = found.unionByName(checks.missing(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem_orders", "l_orderkey"))
    return found.unionByName(checks.missing(t("documents"), "doc_id", t("labels"), "doc_id", "documents_labels", "doc_id"))


def bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return checks.bijection(t("orders").select(F.col("o_custkey").alias("id")), t("customer").select(F.col("c_custkey").alias("id")))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("id"))
    return checks.duplicates(rows, "id")


def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule, then row, that each run of line items breaks."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("pos"), "l_quantity", "l_discount", "l_tax")
    return checks.first_violation(rows, "run_id", "pos", [("quantity_over_45", F.col("l_quantity") > 45), ("discount_over_9", F.col("l_discount") > 0.09), ("no_tax", F.col("l_tax") == 0)])


QUERIES = {f.__name__: f for f in (strip_markup, contains_text, redundant_neighbours, clip_excerpts, transcript_chars, artifact_hash, subtitle_language_choice, fk_violations, bijection, duplicate_ids, first_violation)}

# white space as Unicode has it, for an engine whose own class is ASCII
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_norm = lambda x: f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"
_rstrip = lambda x: f"regexp_replace({x}, '{_WS}+$', '')"
_TURNS = "tu AS (SELECT conv_id AS run_id, turn AS seg_id, role, coalesce(text, '') AS text FROM conversations)"
_within = lambda a, b: f"(length({_norm(a)}) > 0 AND contains(lower({_norm(b)}), lower({_norm(a)})))"
_ENTITIES = _norm("regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')")
# the entities that the pages hold; an ampersand is decoded last, with or without its semicolon, so that nothing is decoded twice
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·")):
    _ENTITIES = f"replace({_ENTITIES}, '{_a}', '{_b}')"
_ENTITIES = f"regexp_replace({_ENTITIES}, '&amp;?', '&', 'g')"

ORACLE_SQL = {
    "subtitle_language_choice": """WITH r AS (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 2 END AS kind, CASE WHEN doc_id % 3 = 0 THEN lang ELSE lang || '-' || CAST(doc_id % 5 AS VARCHAR) END AS language FROM documents WHERE lang IS NOT NULL),
p AS (SELECT source, language, kind + CASE WHEN language = pref THEN 0 ELSE 1 END AS tier, pos FROM r, (VALUES (0, 'es'), (1, 'de'), (2, 'fr'), (3, 'en')) AS q(pos, pref) WHERE language = pref OR starts_with(language, pref || '-')),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier, pos, language) AS k FROM p) SELECT source, CAST(tier AS BIGINT) AS tier, language FROM o WHERE k = 1""",
    "strip_markup": f"SELECT page_id, sha256(trim({_ENTITIES})) AS text_sha, 'assets/keyframes/' || string_split(url, '/')[-1] AS image_path FROM pages",
    "contains_text": f"WITH {_TURNS}, n AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM tu WINDOW w AS (PARTITION BY run_id ORDER BY seg_id)) SELECT run_id, seg_id, coalesce({_within('text', 'b')}, false) AS in_before, coalesce({_within('text', 'a')}, false) AS in_after FROM n",
    "redundant_neighbours": f"WITH {_TURNS}, n AS (SELECT *, coalesce(lag(text) OVER w, '') AS b, coalesce(lead(text) OVER w, '') AS a FROM tu WINDOW w AS (PARTITION BY run_id ORDER BY seg_id)) SELECT run_id, count(*) AS n_turns, count(*) FILTER (WHERE {_within('text', 'b')} OR {_within('text', 'a')}) AS n_redundant FROM n GROUP BY run_id",
    "clip_excerpts": f"""WITH {_TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seg_id) AS k, count(*) OVER (PARTITION BY run_id) AS n, {_norm('text')} AS x FROM tu),
h AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_norm('l')}), lambda l: length(l) >= 40) AS lines FROM o)
SELECT run_id, seg_id, CASE WHEN length(x) <= 60 THEN x ELSE {_rstrip('substr(x, 1, 57)')} || '...' END AS excerpt, {_rstrip('substr(x, 1, 12)')} AS cut, coalesce(lines[1], CASE WHEN length(x) >= 40 THEN x END) AS hint FROM h WHERE n <= 3 OR k = 1 OR k = n // 2 + 1 OR k = n""",
    "transcript_chars": f"WITH {_TURNS} SELECT run_id, min(seg_id) AS first_turn, max(seg_id) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS n_chars, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM tu GROUP BY run_id",
    "artifact_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents",
    "fk_violations": """SELECT 'orders_customer' AS rule, o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'customer_orders', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)
UNION ALL SELECT 'lineitem_orders', l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'documents_labels', doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "bijection": """SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n_only_left, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_only_right,
(SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1) x) AS n_repeated""",
    "duplicate_ids": "SELECT sha256(text) AS id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "first_violation": """WITH v AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS pos, CASE WHEN l_quantity > 45 THEN 1 WHEN l_discount > 0.09 THEN 2 WHEN l_tax = 0 THEN 3 END AS rule FROM lineitem),
a AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS pos, unnest([CASE WHEN l_quantity > 45 THEN 0 END, CASE WHEN l_discount > 0.09 THEN 1 END, CASE WHEN l_tax = 0 THEN 2 END]) AS rule FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rule, pos) AS k FROM a WHERE rule IS NOT NULL)
SELECT run_id, ['quantity_over_45', 'discount_over_9', 'no_tax'][rule + 1] AS rule, pos FROM o WHERE k = 1""",
}
