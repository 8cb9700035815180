"""Queries of the training-data operators and the DuckDB SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import blocknames, dartminhash, discriminant, latticepieces, novelty, phrases, semicrf, urlrules, warcindex, winnowing
from .scratch import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.assignments(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semicrf.personal_data(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.removals(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warcindex.round_trip(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.verdicts(table(spark, sf_dir, "pages"), urlrules.rule_table(spark))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.secrets(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_classes(table(spark, sf_dir, "documents")).drop("_th")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latticepieces.round_trips(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_pii": op2_pii,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_warc": op4_warc,
        "op5_url_filter": op5_url_filter,
        "op6_secrets": op6_secrets,
        "op7_quality": op7_quality,
        "op8_near_dedup": op8_near_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s)""",
        "op3_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
early AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN early USING (g) WHERE first < doc_id),
gone_by AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS t
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone_by USING (r) LEFT JOIN kept USING (r)""",
        "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, (i // 4)::INTEGER * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM q""",
        "op5_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM u),
rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (
  SELECT r, h || q AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC) AS k
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (r)""",
        "op8_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
-- A text stands for its copies: rows of equal words, or of equal texts where there are no words.
k AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY CASE WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 't' || t END) AS node FROM d),
g AS (
  SELECT DISTINCT node, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM k WHERE doc_id = node AND len(w) > 0)),
n AS (SELECT node, count(*) AS n FROM g GROUP BY node),
link AS (
  SELECT a.node AS u, b.node AS v FROM g a JOIN g b ON a.s = b.s AND a.node < b.node JOIN n x ON x.node = a.node JOIN n y ON y.node = b.node
  GROUP BY a.node, b.node, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(node, root) AS (SELECT node, node FROM k WHERE doc_id = node UNION SELECT e.v, r.root FROM reach r JOIN edge e ON e.u = r.node),
class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM k JOIN class USING (node)""",
        "op9_decontamination": r"""
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
b AS (
  SELECT item_id, w, least(10, len(w)) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, f)
  WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, f),
dw AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b))),
hit AS (SELECT r, m, i, item_id FROM dw JOIN bw USING (m, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    }
