"""The registered queries of this subpackage, and their SQL where SQL can express them at a bearable cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, license_scan, near_dup, packing, pii, secret_scan, topk, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_pack, op2_secrets, op3_licenses, op4_near_dup, op5_pii, op6_decontaminate, op7_topk, op8_urls, op9_language, op10_toxicity)
}

_KINDS, _SUFFIXES = (", ".join(f"'{k}'" for k in x) for x in (url_filter.KINDS, url_filter.SUFFIXES))
_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
)
_BLOCKING = ", ".join(f"'{h}{p}'" for v, h, p in url_filter.RULES if v == "block")

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = {
    # Sets of similarity 0.8 share one of the rarest n - ceil(0.8 n) + 1 shingles of either; such pairs are compared whole.
    "op4_near_dup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS place FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM e)
), p AS (SELECT * FROM f WHERE place <= n - (4 * n + 4) // 5 + 1
), c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), l AS (
  SELECT a, b FROM (SELECT c.a, c.b, len(x.s) AS m, len(y.s) AS n, len(list_intersect(x.s, y.s)) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b)
  WHERE 100 * k >= 80 * (m + n - k)
), r AS (
  SELECT doc_id, doc_id AS near FROM s
  UNION
  SELECT r.doc_id, CASE WHEN l.a = r.near THEN l.b ELSE l.a END FROM r JOIN l ON r.near = l.a OR r.near = l.b
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id, m.component_id = s.doc_id AS kept
FROM s JOIN (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id""",
    "op6_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM v))
), h AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM g JOIN v ON v.n = g.n AND v.gram = g.gram
), k AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10""",
    "op8_urls": rf"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r AS (SELECT *, CASE {_RULES} END AS rule FROM h
), l AS (
  SELECT kind || CASE WHEN i = 0 THEN '' ELSE i::VARCHAR END || '.example.' || suffix AS key
  FROM (SELECT unnest([{_KINDS}]) AS kind), (SELECT unnest([{_SUFFIXES}]) AS suffix), (SELECT range AS i FROM range({url_filter.NUMBERED}))
), k AS (SELECT host, list_transform(range(1, len(p) + 1), lambda i: array_to_string(list_slice(p, i, len(p)), '.')) AS keys FROM (SELECT DISTINCT host, string_split(host, '.') AS p FROM h)
), b AS (SELECT DISTINCT host FROM (SELECT host, unnest(keys) AS key FROM k) JOIN l USING (key))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({_BLOCKING}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
}
