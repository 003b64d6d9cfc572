"""op4: benchmark windows in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..decontaminate import decontaminate

NAME = "op4_decontaminate"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)
), x AS (
  SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d
), h AS (
  SELECT x.id, x.i, p.m, p.item
  FROM (SELECT DISTINCT m FROM p) k JOIN x ON x.i + k.m - 1 <= len(x.ws) JOIN p ON p.m = k.m AND p.g = array_to_string(x.ws[x.i:x.i + k.m - 1], ' ')
), n AS (
  SELECT id, count(*) AS k FROM (SELECT DISTINCT id, unnest(range(i, i + m)) AS j FROM h) GROUP BY id
), t AS (
  SELECT id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM h) GROUP BY id
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n.k, 0) AS n_hit, coalesce(t.k, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.k, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (id) LEFT JOIN t USING (id)
"""
