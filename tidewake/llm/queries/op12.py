"""op12: collocations of each language of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..phrases import collocations

NAME = "op12_phrase_collocations"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=100, longest=5, best=2000)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM p
), t AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)))
  GROUP BY ALL HAVING count(*) >= 100
), s AS (
  SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), c AS (
  SELECT s.lang, s.phrase, a, cut, l.f AS l, r.f AS r, n, CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM s JOIN t ON t.lang = s.lang
  JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
), b AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), d AS (
  SELECT * FROM b WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = b.lang AND length(f.phrase) > length(b.phrase) AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * f.f >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d QUALIFY rank <= 2000
"""
