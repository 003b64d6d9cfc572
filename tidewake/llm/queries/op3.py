"""op3: license phrases and notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..licenses import ENOUGH, PHRASES, TEMPLATES, WIDTH, license_scan

NAME = "op3_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ROWS = ", ".join(f"({i}, '{label}', {i < len(PHRASES)}, '{text}')" for i, (label, text) in enumerate(PHRASES + TEMPLATES))
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), x AS (
  SELECT id, i - 1 AS pos, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), p AS (
  SELECT *, string_split(text, ' ') AS ws FROM (VALUES {_ROWS}) AS v(template, label, phrase, text)
), t AS (
  SELECT template, label, phrase, len(ws) - 2 AS grams, i - 1 AS t_at, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM p)
), v AS (
  SELECT id, template, label, phrase, grams, t_at, pos - t_at AS diagonal FROM x JOIN t USING (g)
), f AS (
  SELECT id, template, label, phrase, grams, diagonal, count(*) AS n FROM (SELECT DISTINCT * FROM v) GROUP BY ALL
), c AS (
  SELECT f.id, f.template, f.label, f.grams, f.diagonal, list([u.diagonal + u.t_at] ORDER BY u.t_at, u.diagonal DESC) AS votes
  FROM f JOIN (SELECT DISTINCT * FROM v) u ON u.id = f.id AND u.template = f.template AND u.diagonal BETWEEN f.diagonal AND f.diagonal + {WIDTH}
  WHERE NOT f.phrase GROUP BY ALL HAVING count(DISTINCT u.t_at) * 100 >= f.grams * {ENOUGH}
), r AS (
  SELECT id, label, phrase, diagonal AS start, 1.0 AS part FROM f WHERE phrase AND n = grams
  UNION ALL
  SELECT id, label, FALSE AS phrase, diagonal AS start,
    len(list_reduce(list_prepend(CAST([] AS BIGINT[]), votes), lambda e, v: list_concat(list_concat(e[1:len(list_filter(e, lambda x: x < v[1]))], v), e[len(list_filter(e, lambda x: x < v[1])) + 2:]))) / grams AS part FROM c
), l AS (
  SELECT id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score
  FROM r WHERE part * 100 >= {ENOUGH} GROUP BY id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN l USING (id)
"""
