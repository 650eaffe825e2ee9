"""DuckDB SQL with the result each query of the corpus operators must have."""

from __future__ import annotations

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next FROM turns),
marked AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) AS escaped,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 WHEN 'assistant' THEN 8 WHEN 'tool' THEN 7
      ELSE 7 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) END AS opening,
    coalesce(before, '') || '>' || role IN ('>system', '>user', 'system>user', 'assistant>user',
      'user>assistant', 'tool>assistant', 'assistant>tool') AS fits,
    next IS NOT NULL OR role IN ('user', 'assistant') AS ends
  FROM numbered)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(opening + escaped + 4)::BIGINT AS formatted_chars,
  bool_and(fits AND ends) AS valid
FROM marked GROUP BY conv_id
"""

OP9 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
placed AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS i, words FROM split WHERE len(words) >= 5),
windows AS (SELECT doc_id, i, words[i:i + 4] AS w FROM placed),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
gaps AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS g FROM twice),
repeats AS (SELECT doc_id, sum(g)::BIGINT AS n FROM gaps GROUP BY doc_id),
measures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    coalesce(repeats.n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    2 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
      OR NOT word_chars BETWEEN 2 * n_words AND 25 * n_words AS own
  FROM measures)
SELECT * EXCLUDE (own), NOT (base_failed OR own) AS kept FROM judged
"""


OP10 = r"""
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""


#: 3988292384 is the reversed polynomial of the 32-bit check sum, a fixed value.
OP11 = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations
  WHERE conv_id IS NOT NULL),
whole AS (
  SELECT c, list(sha256(len(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS t,
    list(octet_length(encode(text)) ORDER BY turn NULLS FIRST, role, text) AS n FROM turns GROUP BY c),
kept AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::UBIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: 0::UBIGINT)),
      lambda v, i: xor(v >> 1, (v & 1) * 3988292384::UBIGINT)))) % 9 AS h FROM whole),
rebuilt AS (
  SELECT k.c, list_concat(coalesce(b.t, [])[1:k.h], k.t[k.h + 1:]) AS t, list_concat(coalesce(b.n, [])[1:k.h], k.n[k.h + 1:]) AS n
  FROM kept k LEFT JOIN whole b ON b.c = k.c - k.c % 5),
members AS (
  SELECT c, d, sha256(array_to_string(t[1:d], ',')) AS node, sha256(array_to_string(t[1:d - 1], ',')) AS parent,
    d = len(t) AS ends, coalesce(n[d], 0) AS bytes
  FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, CASE WHEN d > 0 THEN any_value(parent) END AS parent, count(*) AS n_convs,
    (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, d),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
subtrees AS (
  SELECT m.node, m.d, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens
  FROM nodes x JOIN members m ON m.c = x.conv_id AND m.d <= x.d LEFT JOIN children k ON k.node = x.node AND k.d = x.d
  GROUP BY m.node, m.d)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs,
  coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens, x.ends_sha256
FROM nodes x JOIN subtrees s ON s.node = x.node AND s.d = x.d
  LEFT JOIN nodes p ON p.node = x.parent AND p.d = x.d - 1 LEFT JOIN children k ON k.node = x.node AND k.d = x.d
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op9_quality_rules": OP9, "op10_exact_topk": OP10, "op11_prefix_trie": OP11}
