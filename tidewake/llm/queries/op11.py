"""op11: damaged conversations, their faults and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..conversations import repair_conversations

NAME = "op11_conversation_repair"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_TABLE = "range(256)"
for _ in range(8):
    _TABLE = f"list_transform({_TABLE}, lambda c: {_BIT})"


def _put(value: str, cost: str, letter: str) -> str:
    """A value is its cost, twelve digits wide, and its edits: the least string is the cheapest way and of those the first."""
    return f"printf('%012d', CAST({value}[1:12] AS BIGINT) + {cost}) || '{letter}' || {value}[13:]"


_SPEAK = (2, 2, 3, 2)
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def _row(q: int) -> str:
    """The least way from state q on, with one more row in front."""
    kept = " ".join(f"WHEN c = '{c}' THEN {_put(f'v{to[q]}', 't', 'K')}" for c, to in _KEEP.items() if q in to)
    keep = f"CASE WHEN gone THEN NULL {kept} END"
    change = f"CASE WHEN NOT gone THEN {_put(f'v{_SPEAK[q]}', '2 + t', 'R')} END"
    return f"least({_put(f'v{q}', '3', 'D')}, coalesce({keep}, '~'), coalesce({change}, '~'))"


def _relaxed(v: tuple[str, ...]) -> str:
    user, assistant = f"least({v[2]}, {_put(v[3], '2', 'I')})", f"least({v[3]}, {_put(v[2], '2', 'I')})"
    return f"least({v[0]}, {_put('w2', '2', 'I')}) AS v0, least({v[1]}, {_put('w2', '2', 'I')}) AS v1, w2 AS v2, w3 AS v3 FROM (SELECT *, {user} AS w2, {assistant} AS w3 FROM @)"



_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = f"""
WITH RECURSIVE crcs AS (
  SELECT {_TABLE} AS crc
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda x, y: xor(crc[CAST(xor(x, y) & 255 AS INTEGER) + 1], x >> 8)), 4294967295) % 20 AS kind
  FROM conversations, crcs
), e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, (SELECT unnest([1, 2]) AS k) WHERE kind <> 0 AND (k = 1 OR kind = 3)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS l, rtrim(text, {_SPACE}) AS tail FROM e)
), f AS (
  SELECT *, tail = '' AS blank, tail <> '' AND again AS dup, NOT (tail = '' OR again) AND right(tail, 1) NOT IN ('.', '!', '?') AS cut,
    coalesce(lag(l) OVER (PARTITION BY conv_id ORDER BY i) || l NOT IN ('su', 'ua', 'au'), FALSE) AS illegal,
    CASE WHEN l IN ('s', 'u', 'a') THEN l ELSE 'x' END AS c FROM r
), n AS (
  SELECT conv_id, max(i) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n_rows FROM f GROUP BY conv_id
), z AS (
  SELECT conv_id, m + 1 AS i, '000000000000' AS v0, '000000000004II' AS v1, '000000000002I' AS v2, '000000000000' AS v3 FROM n
  UNION ALL
  SELECT conv_id, i, {_relaxed(('b0', 'b1', 'b2', 'b3')).replace('@', f'''(
    SELECT f.conv_id, f.i, {', '.join(f'{_row(q)} AS b{q}' for q in range(4))}
    FROM z JOIN (SELECT *, blank OR dup AS gone, CAST(cut AS INTEGER) AS t FROM f) f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i = z.i - 1)''')}
), a AS (
  SELECT conv_id, CAST(v0[1:12] AS BIGINT) AS cost, v0[13:] AS audit FROM z WHERE i = 1
), s AS (
  SELECT conv_id, j, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS j FROM a WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), k AS (
  SELECT s.conv_id, s.o, s.e, CASE WHEN s.e <> 'I' THEN f.role END AS role, CASE WHEN s.e = 'I' THEN '' ELSE f.text END AS text,
    max(CASE WHEN s.o = 1 AND s.e = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led
  FROM s LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i AND s.e <> 'I' WHERE s.e <> 'D'
), h AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS lines, count(*) AS n_repaired FROM k GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256, coalesce(n_rows, 0) AS n_rows, coalesce(n_repaired, 0) AS n_repaired
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""
