"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

_CONTROL = r"\[\\*(?:INST\]|/INST\])|<\\*(?:/s>|s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"

ORACLE_SQL = {
    "op1_chat_format": rf"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS esc FROM src
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + esc + 20) AS formatted_chars,
    sum(CASE WHEN esc > 0 THEN 1 ELSE 0 END) AS escaped_turns
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(escaped_turns AS BIGINT) AS escaped_turns,
  true AS round_trip_ok
FROM g""",
    "op11_phrases": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), f AS (
  SELECT lang, w[i] AS w1, CASE WHEN k > 1 THEN w[i + 1] END AS w2, CASE WHEN k > 2 THEN w[i + 2] END AS w3, k, count(*) AS a
  FROM spots, (VALUES (1), (2), (3)) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c2 AS (
  SELECT p.lang, p.w1, p.w2, p.a, x.a AS l, y.a AS r FROM f p
  JOIN f x ON x.k = 1 AND x.lang = p.lang AND x.w1 = p.w1 JOIN f y ON y.k = 1 AND y.lang = p.lang AND y.w1 = p.w2
  WHERE p.k = 2 AND p.a >= 10
), c3 AS (
  SELECT t.lang, t.w1, t.w2, t.w3, t.a, x.l AS l1, y.a AS r1, x.a AS l2, y.r AS r2 FROM f t
  JOIN c2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN c2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  WHERE t.k = 3 AND t.a >= 10
), s3 AS (
  SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r1) AS s1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r2) AS s2 FROM c3
), gone AS (
  SELECT lang, w1, w2 FROM c3 WHERE 100 * a >= 50 * l2 UNION SELECT lang, w2, w3 FROM c3 WHERE 100 * a >= 50 * r1
), scored AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, a, l, r, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM c2 ANTI JOIN gone USING (lang, w1, w2)
  UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM s3
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
