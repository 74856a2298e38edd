"""DuckDB SQL for those text queries that SQL can express."""

from __future__ import annotations

from modeloom.llm.licenses import SHARE, TEMPLATES

SPACES = r"[\x20\x09-\x0D]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, gaps: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{gaps}'), lambda x: x <> '')"


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')", SPACES)} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM p),
h AS (SELECT r, i, COUNT(*) OVER (PARTITION BY r, a, b, c) AS n FROM g),
k AS (SELECT r, COUNT(DISTINCT i + o) AS n_repeat_words FROM h CROSS JOIN range(0, 3) t(o) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars, text,
CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
FROM d LEFT JOIN k USING (r) LEFT JOIN m USING (r)),
o AS (SELECT *, coalesce(word_chars, 0) AS wc, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, wc AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 40 * wc OR wc > 25 * n_words OR wc < 2 * n_words
OR 100 * n_dup_lines > 40 * len(string_split(text, chr(10))) OR 100 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > 40 * n_words) AS kept FROM o"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words(FOLD, GAPS)} AS w FROM documents),
b AS (SELECT item_id, {words(FOLD, GAPS)} AS v FROM benchmark),
i AS (SELECT item_id, least(10, len(v)) AS k, unnest(range(1, len(v) - least(10, len(v)) + 2)) AS s, v FROM b WHERE len(v) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(v[s:s + k - 1], ' ') AS content FROM i),
sizes AS (SELECT DISTINCT k FROM win),
p AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= k),
q AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS content FROM p),
hit AS (SELECT r, s, k, item_id FROM q JOIN win USING (k, content)),
inside AS (SELECT r, COUNT(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS pos FROM hit) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN inside USING (r) LEFT JOIN found USING (r)"""


def _quoted(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def licenses() -> str:
    """Every place where a template's key phrase stands is weighed; no index, so all words are looked at."""
    rows = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {_quoted(t.words)}, {t.key[0]}, {_quoted(t.words[t.key[0] : t.key[1]])})" for n, t in enumerate(TEMPLATES))
    return f"""
WITH tpl(id, label, base, words, k0, phrase) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, {words(FOLD, GAPS)} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (SELECT r, i - 1 - k0 AS start, label, base, words, w FROM p JOIN tpl ON w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
m AS (SELECT r, start, label, base, len(list_filter(range(0, len(words)), lambda j: coalesce(start + j >= 0 AND w[start + j + 1] = words[j + 1], false))) / CAST(len(words) AS DOUBLE) AS share FROM c),
f AS (SELECT * FROM m WHERE share >= CASE WHEN base THEN 1 ELSE {SHARE} END),
s AS (SELECT r, MAX(share) AS score FROM m GROUP BY r),
g AS (SELECT r, COUNT(*) FILTER (base) AS n_base, MIN(start) FILTER (base) AS first_word, MAX(start) FILTER (base) AS last_word,
array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN g USING (r) LEFT JOIN s USING (r)"""


ORACLES = {"op3_license_scan": licenses(), "op4_quality_rules": QUALITY, "op8_decontamination": DECONTAMINATION}
