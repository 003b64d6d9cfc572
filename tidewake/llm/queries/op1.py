"""op1: near-duplicate components of all documents by five-word shingles and a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..jaccard import ngram_jaccard

NAME = "op1_ngram_jaccard"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=5, percent=80)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), g AS (
  SELECT doc_id, unnest(sh) AS gram, len(sh) AS n FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS o
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p WHERE 100 * o >= 80 * (total - o)
), u AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM s
  UNION
  SELECT r.x, u.y FROM r JOIN u ON r.y = u.x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM s JOIN r ON s.doc_id = r.x GROUP BY s.doc_id, s.sh
"""
