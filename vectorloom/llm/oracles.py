"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from vectorloom.llm.lines import BOILERPLATE, SEPARATORS, TERMINAL

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_BARS = " + ".join(f"(length(' ' || t || ' ') - length(replace(' ' || t || ' ', {_quoted(f' {c} ')}, ''))) // {len(c) + 2}" for c in SEPARATORS)
_STOCK = " OR ".join(f"contains(lower(t), {_quoted(p)})" for p in BOILERPLATE)
_ENDS = ", ".join(_quoted(c) for c in TERMINAL)

LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM r WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(5, coalesce(later - i, 5))) AS n FROM s GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
t AS (SELECT doc_id, line, trim(regexp_replace(line, '[\x09\x0B-\x0D]', ' ', 'g'), ' ') AS t FROM l),
v AS (SELECT doc_id, line, t, length(t) - length(replace(t, ' ', '')) + 1 AS n FROM t WHERE t <> ''),
f AS (SELECT doc_id, line, length(replace(t, ' ', '')) AS ink,
  right(t, 1) NOT IN ({_ENDS}) OR 2 * (len(regexp_extract_all(t, '[#*$%&|<>]+')) + len(regexp_extract_all(t, '[!?]{{2,}}'))) >= n OR 6 * ({_BARS}) >= n OR {_STOCK} AS fails FROM v),
p AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, coalesce(sum(ink) FILTER (WHERE fails), 0) AS lost FROM f GROUP BY doc_id),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM b
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS piece,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM c),
x AS (SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY back DESC) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY back DESC)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY back DESC) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR back = 1), 0) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
e AS (SELECT x, y FROM k UNION SELECT y, x FROM k),
reach(a, b) AS (SELECT x, y FROM e UNION SELECT a, y FROM reach JOIN e ON b = x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = d.doc_id GROUP BY d.doc_id, n.n
"""

ORACLES = {"op4_line_cleaning": LINES, "op8_chat_expansion": CHAT, "op9_ngram_jaccard": JACCARD}
