"""op7: secrets in all documents, told apart by how many owners have them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..secrets import ACCESS, ASSIGN, HEX, VENDOR, secret_scan

NAME = "op7_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), owner="source", repository="source", common_owners=3, common_repositories=5)


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT id, {kind} AS kind, v, p[1:i].list_transform(lambda x: length(x)).list_sum() + coalesce(m[1:i - 1].list_transform(lambda x: length(x)).list_sum(), 0) AS s, length(m[i]) AS k
  FROM (SELECT id, m, p, unnest(g) AS v, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT id, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS g, string_split_regex(text, '{quoted}') AS p FROM d))
  WHERE length(v) >= {least}"""


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents
), a AS ({_spans(0, ASSIGN, 1, 6)} UNION ALL {_spans(1, ACCESS, 0, 20)} UNION ALL {_spans(2, HEX, 0, 24)} UNION ALL {_spans(3, VENDOR, 0, 1)}
), f AS (
  SELECT v FROM a JOIN d USING (id) GROUP BY v HAVING count(DISTINCT source) >= 3
), t AS (
  SELECT id, ['assign', 'access', 'hex', 'vendor'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + k AS BIGINT) AS span, kind, s, v NOT IN (SELECT v FROM f) AS live FROM a
), g AS (
  SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (live) AS n_live,
    string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans
  FROM t GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (id)
"""
