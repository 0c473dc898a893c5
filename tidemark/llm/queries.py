"""The operators' registered queries: each applies one operator to its whole table and digests what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import brown, line_runs, merkle, mixing, packing, phrases, pu_quality, quality, simhash, token_store, trie_join, voronoi, warc
from .common import saved, table, work_dir
from .tokens import default_vocabulary


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, default_vocabulary(), end_id=2)
    held = token_store.read_tokens(spark, path)
    return held.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voronoi.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256, F.col("vec_id") % 50 == 0)
    return voronoi.top_k(rows, work_dir(spark), k=5)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality.ledger(table(spark, sf_dir, "documents"))
    failed = F.col("failed").bitwiseAND(F.lit(quality.BASE).cast("long")) != 0
    return held.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), quality.passes("web-1").alias("kept"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=1, capacity=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), work_dir(spark), width=4, radius=4)
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    inputs = saved(pu_quality.features(table(spark, sf_dir, "documents")), f"{path}/inputs")
    model = pu_quality.train(inputs, table(spark, sf_dir, "labels"), pu_quality.fold(5) != 0, path)
    held_out = F.coalesce(pu_quality.fold(5) == 0, F.lit(False)).alias("held_out")
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return pu_quality.score(inputs, model).select("doc_id", held_out, "score", predicted)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_runs.drop_shared_lines(table(spark, sf_dir, "documents"), min_chars=1, min_docs=10)
    return left.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path, least=1000)
    records = warc.read_archives(spark, path)
    records = records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")}).drop("payload")
    c, fields = F.col, F.col("metadata.fields")
    return warc.transactions(records).select(
        fields["page-id"].cast("long").alias("page_id"),
        # a revisit has no payload: its length stands in the metadata record, its digest in the header
        F.coalesce(c("response.payload_bytes"), fields["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.coalesce(c("response.payload_sha1"), F.substring_index("response.digest", ":", -1)).alias("payload_digest"),
        c("response.type").alias("record_type"),
        fields["answering-page-id"].cast("long").alias("refers_to"),
    )


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), work_dir(spark)
    model, counts = brown.train(docs.where(~brown.held_out(7, 2)), f"{path}/train")
    held = brown.score(docs, model, counts, f"{path}/score")
    return held.select("doc_id", brown.held_out(7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.digest(*[merkle.field(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in fields])
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    held = merkle.manifest(docs, work_dir(spark), fields, "lang", "doc_id", {"doc_id": F.col("doc_id"), "tampered": F.when(hit, tampered)})
    root = merkle.folded(F.coalesce("tampered", "leaf"))
    held = held.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), root.alias("folded_root"))
    return held.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.similar_documents(table(spark, sf_dir, "documents"), work_dir(spark), width=5, percent=80)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), work_dir(spark), least=100, longest=5, top=2000)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_token_store, op3_top_k, op4_quality_rules, op5_pack, op6_simhash, op7_quality_classifier, op8_line_dedup, op9_warc, op10_class_lm, op11_merkle, op12_jaccard, op13_phrases)} | {"pipeline": corpus_pipeline.run}

_SPACES = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op3_top_k": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON q.r <> e.r WHERE q.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 5
""",
    "op4_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
v AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM v) WHERE c > 1),
n AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_SPACES}, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
      length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, length(t) - length(translate(t, '0123456789', '')) AS n_digits,
      length(t) - length(translate(t, '!', '')) AS n_exclamations FROM w LEFT JOIN n ON w.r = n.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT ({" OR ".join(f"({condition})" for _, condition in quality.RULES)}) AS kept
FROM m
""",
    "op8_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, s.key IS NOT NULL AS gone FROM k LEFT JOIN s ON k.key = s.key) x
GROUP BY r
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS top, count(*) AS c FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
""",
    "op11_merkle": """
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
      coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
      list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda b, i: xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM documents),
d AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || tail) AS leaf,
      CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') || tail) END AS tampered FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, n, 0 AS level, k, leaf AS h FROM r
      UNION ALL SELECT lang, n, level + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)) FROM t WHERE n > (1 << level) GROUP BY lang, n, level, k // 2),
s AS (SELECT *, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM (SELECT lang, arg_max(h, level) AS subroot FROM t GROUP BY lang)),
u AS (SELECT n, 0 AS level, k, subroot AS h FROM s
      UNION ALL SELECT n, level + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)) FROM u WHERE n > (1 << level) GROUP BY n, level, k // 2),
root AS (SELECT arg_max(h, level) AS root FROM u),
above AS (SELECT s.lang, list(CASE WHEN u.h IS NULL THEN 'N' WHEN (s.k >> e.level) % 2 = 1 THEN 'L' || u.h ELSE 'R' || u.h END ORDER BY e.level) AS up
      FROM s JOIN (SELECT DISTINCT level FROM u) e ON s.n > (1 << e.level) LEFT JOIN u ON u.level = e.level AND u.k = xor(s.k >> e.level, 1) GROUP BY s.lang),
own AS (SELECT r.lang, r.k, list(CASE WHEN t.h IS NULL THEN 'N' WHEN (r.k >> e.level) % 2 = 1 THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY e.level) AS up
      FROM r JOIN (SELECT DISTINCT level FROM t) e ON r.n > (1 << e.level) LEFT JOIN t ON t.lang IS NOT DISTINCT FROM r.lang AND t.level = e.level AND t.k = xor(r.k >> e.level, 1) GROUP BY r.lang, r.k),
p AS (SELECT r.*, s.subroot, root.root, coalesce(own.up, []) || coalesce(above.up, []) AS up FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root
      LEFT JOIN own ON own.lang IS NOT DISTINCT FROM r.lang AND own.k = r.k LEFT JOIN above ON above.lang IS NOT DISTINCT FROM r.lang),
g AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(up, lambda x: x[2:]), '')) AS proof_sha256,
      list_reduce(list_prepend(coalesce(tampered, leaf), up), lambda h, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || h WHEN 'R' THEN h || x[2:] ELSE h END)) AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM g
""",
    "op12_jaccard": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS h FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.r <> y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN (SELECT a, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = b GROUP BY a) c ON c.a = d.r
""",
    "op13_phrases": """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i, range(1, 6) AS r(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE k > 1 AND f >= 100),
kept AS (SELECT * FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.k > x.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
cut AS (SELECT lang, phrase, a, v, k, unnest(range(1, k)) AS j FROM kept),
s AS (SELECT cut.*, l.f AS l, r.f AS r, n.n, CAST((CAST(a AS HUGEINT) * n.n * 1000) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(v[:j], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(v[j + 1:], ' ') JOIN n ON n.lang = cut.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
""",
}
