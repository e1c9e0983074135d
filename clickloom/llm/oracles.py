"""SQL of the text queries that SQL can express, over the given tables."""

from __future__ import annotations

from clickloom.llm.common import UPPER
from clickloom.llm.license_join import PHRASES, STRIDE, TEMPLATES, THRESHOLD


def _words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}')"
    return f"regexp_extract_all({lowered}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


OP5 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS piece, least(len(w), 13) AS size
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k
        FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS piece
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k
        FROM d, (SELECT DISTINCT size FROM iw))),
hits AS (SELECT doc_id, k, size, item_id FROM dw JOIN iw USING (piece, size)),
places AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words("text")} AS w FROM documents),
p(phrase, label) AS (VALUES {_PHRASES}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(k) - 1 AS first_word, max(k) - 1 AS last_word,
    list(DISTINCT label) AS labels
  FROM (SELECT doc_id, label, phrase, w, unnest(generate_series(1, len(w) - len(phrase) + 1)) AS k
        FROM d, p)
  WHERE w[k:k + len(phrase) - 1] = phrase GROUP BY doc_id),
t AS (
  SELECT template, label, list_distinct({_words("notice")}) AS tokens
  FROM (VALUES {_TEMPLATES}) AS v(template, label, notice)),
b AS (
  SELECT doc_id, place,
    list_distinct(w[{STRIDE} * place + 1:{STRIDE} * place + 2 * {STRIDE}]) AS words
  FROM (SELECT doc_id, w, unnest(range((len(w) + {STRIDE} - 1) // {STRIDE})) AS place FROM d)),
hit AS (
  SELECT doc_id, place, label, list_intersect(words, tokens) AS matched,
    len(list_intersect(words, tokens)) AS overlap,
    len(list_intersect(words, tokens)) / len(tokens) AS containment
  FROM b, t WHERE len(list_intersect(words, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
closest AS (
  SELECT * FROM hit h WHERE NOT EXISTS (
    SELECT 1 FROM hit o WHERE o.doc_id IS NOT DISTINCT FROM h.doc_id AND o.place = h.place
      AND (o.containment > h.containment OR (o.containment = h.containment AND o.overlap > h.overlap))
      AND len(list_intersect(h.matched, o.matched)) = h.overlap)),
found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best
  FROM closest GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(
    coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_TAIL = r"(\||/?s>|/?INST\]|<SYS>>|</?SYS>>)"


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*){_TAIL}', '\1\\\2\3', 'g')"


_ROLE = "replace(replace(role, '%', '%25'), chr(10), '%0A')"

OP10 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(24 + length({_escaped(_ROLE)}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLE: dict[str, str] = {
    "op5_decontamination": OP5,
    "op8_license_scan": OP8,
    "op10_chat_format": OP10,
}
