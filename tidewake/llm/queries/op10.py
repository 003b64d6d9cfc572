"""op10: quality counts and the repetition verdict of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..quality import quality_rules

NAME = "op10_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_repeat=5, max_covered=35, max_repeat=100)


#: A word is covered by a repeat of 5 words or more if it is in a 5-word run found twice. The longest repeat follows from
#: diagonals: neighbouring 5-word runs that pair up at the same distance.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), x AS (
  SELECT id, len(ws) AS n, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g8 AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(ws[i:i + 7], ' ')) AS c FROM x WHERE i + 7 <= n
), r8 AS (
  SELECT id, count(*) AS k FROM (SELECT DISTINCT id, unnest(range(i, i + 8)) AS j FROM g8 WHERE c > 1) GROUP BY id
), g5 AS (
  SELECT id, i, array_to_string(ws[i:i + 4], ' ') AS g, count(*) OVER (PARTITION BY id, array_to_string(ws[i:i + 4], ' ')) AS c FROM x WHERE i + 4 <= n
), h5 AS (
  SELECT id, i, g FROM g5 WHERE c > 1
), r5 AS (
  SELECT id, count(*) AS k FROM (SELECT DISTINCT id, unnest(range(i, i + 5)) AS j FROM h5) GROUP BY id
), e AS (
  SELECT a.id, a.i, b.i - a.i AS d, a.i - row_number() OVER (PARTITION BY a.id, b.i - a.i ORDER BY a.i) AS island
  FROM h5 a JOIN h5 b ON a.id = b.id AND a.g = b.g AND a.i < b.i
), m AS (
  SELECT id, max(k) + 4 AS longest FROM (SELECT id, d, island, count(*) AS k FROM e GROUP BY 1, 2, 3) GROUP BY id
), l AS (
  SELECT id, count(*) - count(DISTINCT line) AS k FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), s AS (
  SELECT w.id, doc_id, len(ws) AS n, length(array_to_string(ws, '')) AS chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS symbols,
    coalesce(l.k, 0) AS dups, coalesce(r8.k, 0) AS rep, coalesce(r5.k, 0) AS cov, coalesce(m.longest, 0) AS longest
  FROM w LEFT JOIN l USING (id) LEFT JOIN r8 USING (id) LEFT JOIN r5 USING (id) LEFT JOIN m USING (id)
)
SELECT doc_id, n AS n_words, chars AS word_chars, symbols AS n_symbols, dups AS n_dup_lines, rep AS n_repeat_words, cov AS covered_words,
  longest AS longest_repeat, n < 20 OR 100 * rep > 30 * n AS base_failed,
  NOT (n < 20 OR 100 * rep > 30 * n) AND 100 * cov <= 35 * n AND longest <= 100 AS kept
FROM s
"""
