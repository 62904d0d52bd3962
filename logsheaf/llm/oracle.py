"""SQL for the same rows as the registered queries, for those that SQL can express."""

from __future__ import annotations

from logsheaf.llm.decontamination import (
    LEAST_SHARE,
    LEAST_TOKENS,
    LEAST_WINDOW,
    NUMBER,
    TOKEN,
    UNITS,
    UNSPACED,
    WINDOW,
)
from logsheaf.llm.secret_scan import BASE, RULES

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
         ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
         FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g'))
     )::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _secrets() -> str:
    """Positions come from the lengths of the matches and of what lies between them."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind,
      unnest(range(1, len(m) + 1)) AS i, m, v, p, {rule.least} AS least
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m,
            regexp_extract_all(text, '{pattern}', {rule.value}) AS v,
            string_split_regex(text, '{pattern}') AS p FROM texts)"""
        )
    base = ", ".join(f"'{rule.kind}'" for rule in BASE)
    counts = ", ".join(
        f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE
    )
    named = ", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in BASE)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(parts)}),
spans AS (
  SELECT doc_id, rank, kind,
    list_sum(list_transform(p[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start,
    length(m[i]) AS size
  FROM matches WHERE length(v[i]) >= least
),
listed AS (
  SELECT doc_id, {counts},
    coalesce(string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ','
      ORDER BY start, rank) FILTER (kind IN ({base})), '') AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ','
      ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT texts.doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed ON texts.doc_id = listed.doc_id
"""


SECRETS = _secrets()

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON doc_id = a
"""


def _contaminated() -> str:
    """Every window as text, alignments by their shift, slots and conflicts counted per alignment.

    Characters of scripts without spaces are set apart first, so that each is a token.
    """
    units = ", ".join(f"'{unit}'" for unit in UNITS)

    def formed(source: str, key: str) -> str:
        return f"""
  SELECT {key}, w, plain, list_transform(w, lambda x: lower(x)) AS exact,
    list_transform(range(1, len(w) + 1), lambda i:
      CASE WHEN NOT starts_with(plain[i], '<') AND w[i] <> plain[i] THEN '<name>' ELSE plain[i] END
    ) AS template
  FROM (SELECT *, list_transform(w, lambda x:
      CASE WHEN regexp_matches(lower(x), '{NUMBER}') THEN '<num>'
        WHEN lower(x) IN ({units}) THEN '<unit>' ELSE lower(x) END) AS plain
    FROM (SELECT {key}, regexp_extract_all(
        regexp_replace(coalesce(text, ''), '([{UNSPACED}])', ' \\1 ', 'g'), '{TOKEN}') AS w FROM {source}))"""

    def cut(source: str, key: str, form: str, where: str = "true") -> str:
        return f"""
  SELECT {key}, size, pos, {form}[pos:pos + size - 1] AS win
  FROM (SELECT *, unnest(range(1, len({form}) - size + 2)) AS pos FROM {source}) WHERE {where}"""

    def literal(form: str) -> str:
        counted = f"len(list_filter({form}[pos:pos + size - 1], lambda f: NOT starts_with(f, '<')))"
        return f"size >= {LEAST_WINDOW} AND 2 * {counted} >= size"

    return f"""
WITH docs AS ({formed("documents", "doc_id")}),
items AS (
  SELECT *, least(len(w), {WINDOW}) AS size FROM ({formed("benchmark", "item_id")}) WHERE len(w) > 0
),
sized AS (SELECT docs.*, size FROM docs, (SELECT DISTINCT size FROM items)),
ours AS (
  {cut("sized", "doc_id", "template", f"size >= {LEAST_WINDOW}")}
  UNION {cut("sized", "doc_id", "plain", f"size >= {LEAST_WINDOW}")}
  UNION {cut("sized", "doc_id", "exact")}
),
theirs AS (
  {cut("items", "item_id", "template", literal("template"))}
  UNION {cut("items", "item_id", "plain", literal("plain"))}
  UNION {cut("items", "item_id", "exact", f"NOT ({literal('plain')})")}
),
aligned AS (
  SELECT doc_id, item_id, ours.pos - theirs.pos AS shift, size, list(DISTINCT theirs.pos) AS starts
  FROM ours JOIN theirs USING (size, win) GROUP BY ALL
),
places AS (
  SELECT *, {{'a': a, 'b': b, 'form': form}} AS slot, starts_with(form, '<') AS is_slot
  FROM (
    SELECT doc_id, item_id, shift, place, lower(items.w[place]) AS a, lower(docs.w[place + shift]) AS b,
      items.template[place] AS form
    FROM (SELECT DISTINCT doc_id, item_id, shift,
            unnest(flatten(list_transform(starts, lambda s: range(s, s + size)))) AS place FROM aligned)
    JOIN docs USING (doc_id) JOIN items USING (item_id))
),
slots AS (
  SELECT doc_id, item_id, shift, coalesce(list(DISTINCT slot) FILTER (is_slot), []) AS slots,
    coalesce(list(place) FILTER (a <> b), []) AS edits
  FROM places GROUP BY ALL
),
judged AS (
  SELECT *, len(list_distinct(list_transform(slots, lambda s: s.a))) = len(slots)
      AND len(list_distinct(list_transform(names, lambda s: s.b))) = len(names) AS consistent,
    list_filter(slots, lambda s: len(list_filter(slots, lambda t: (s.a = t.a) <> (s.b = t.b))) > 0) AS clashing
  FROM (SELECT *, list_filter(slots, lambda s: s.form = '<name>') AS names FROM slots)
),
clashes AS (
  SELECT doc_id, item_id, shift, coalesce(list(place) FILTER (is_slot AND list_contains(clashing, slot)), []) AS clashes
  FROM places JOIN judged USING (doc_id, item_id, shift) GROUP BY ALL
),
kept AS (
  SELECT doc_id, item_id, shift, size, CASE WHEN consistent THEN starts ELSE list_filter(starts, lambda x:
      len(list_filter(clashes, lambda p: p >= x AND p < x + size)) = 0
      OR len(list_filter(edits, lambda p: p >= x AND p < x + size)) = 0) END AS starts
  FROM aligned JOIN judged USING (doc_id, item_id, shift) JOIN clashes USING (doc_id, item_id, shift)
),
covered AS (
  SELECT DISTINCT doc_id, item_id, shift,
    unnest(flatten(list_transform(starts, lambda s: range(s, s + size)))) AS place FROM kept
),
counted AS (
  SELECT doc_id, item_id, shift, count(*) AS n_tokens, count(DISTINCT slot) FILTER (is_slot) AS n_slots,
    count(DISTINCT slot) FILTER (is_slot AND a <> b) AS n_changed
  FROM covered JOIN places USING (doc_id, item_id, shift, place) GROUP BY ALL
)
SELECT doc_id, item_id, len(starts)::INTEGER AS n_windows,
  len(starts) / (len(items.w) - items.size + 1) AS coverage, n_slots::INTEGER AS n_slots,
  n_changed::INTEGER AS n_changed
FROM kept JOIN counted USING (doc_id, item_id, shift) JOIN items USING (item_id)
WHERE n_tokens >= {LEAST_TOKENS} OR coverage >= {LEAST_SHARE}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id
  ORDER BY n_windows DESC, coverage DESC, n_changed, n_slots DESC) = 1
"""


DECONTAMINATION = _contaminated()
