"""SQL for the rows of the conversation queries."""

from __future__ import annotations

CRC = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
)"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, unsigned; the query must join ``crc_table``."""
    characters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {characters}), {step}), 4294967295)"


# A state of the repair is one text: eight digits of cost, then the edits.
NEVER = "'90000000'"


def _plus(state: str, cost: str, edit: str) -> str:
    total = f"printf('%08d', CAST(substr({state}, 1, 8) AS INTEGER) + {cost})"
    return f"({total} || substr({state}, 9) || '{edit}')"


def _turn(after: str, *origins: tuple[str, str]) -> str:
    """The best text for ``after``: deleting in it, or keeping or rewriting from (state, initial)."""
    options = [_plus(after, "2", "D")]
    for state, initial in origins:
        kept = f"open AND initial = '{initial}'"
        options.append(f"CASE WHEN {kept} THEN {_plus(state, 'extra', 'K')} ELSE {NEVER} END")
        if initial != "s":
            options.append(f"CASE WHEN open THEN {_plus(state, 'extra + 1', 'R')} ELSE {NEVER} END")
    return f"least({', '.join(options)})"


REPAIR = rf"""
WITH RECURSIVE {CRC},
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated
),
turns AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
    row_number() OVER same AS seen, row_number() OVER own AS rn,
    lag(substr(role, 1, 1)) OVER own AS before,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last
  FROM damaged
  WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy),
    same AS (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy)
),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM turns
),
rows_of AS (
  SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS open,
    CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged
),
convs AS (
  SELECT c.conv_id, count(r.rn) AS n, count(*) FILTER (r.fault = 'blank') AS blank,
    count(*) FILTER (r.fault = 'duplicate') AS duplicate,
    count(*) FILTER (r.fault = 'truncated') AS truncated,
    count(*) FILTER (r.before || r.initial NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0) AS gaps
  FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, '00000000' AS e, {NEVER} AS s, '00000005I' AS u, '00000010II' AS p
  FROM convs
  UNION ALL
  SELECT conv_id, i, e, s, least(u, {_plus("e", "5", "I")}, {_plus("s", "5", "I")}, {_plus("p", "5", "I")}) AS u,
    least(p, {_plus("least(u, " + ", ".join(_plus(x, "5", "I") for x in "esp") + ")", "5", "I")}) AS p
  FROM (
    SELECT d.conv_id, d.i + 1 AS i, {_plus("e", "2", "D")} AS e,
      {_turn("s", ("e", "s"))} AS s,
      {_turn("u", ("e", "u"), ("s", "u"), ("p", "u"))} AS u,
      {_turn("p", ("u", "a"))} AS p
    FROM dp d JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.rn = d.i + 1
  )
),
best AS (
  SELECT c.*, CASE WHEN c.n = 0 THEN '00000000' ELSE least(e, p) END AS b
  FROM convs c JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.n
),
edits AS (
  SELECT conv_id, k, substr(b, 8 + k, 1) AS edit,
    length(replace(substr(b, 9, k), 'I', '')) AS rn, length(replace(substr(b, 9, k), 'D', '')) AS place
  FROM (SELECT conv_id, b, unnest(range(1, length(b) - 7)) AS k FROM best)
),
finals AS (
  SELECT e.conv_id, e.place, e.edit, CASE WHEN e.edit = 'I' THEN '' ELSE r.text END AS text, r.role,
    coalesce(max(CASE WHEN e.place = 1 AND e.edit = 'K' AND r.initial = 's' THEN 1 END)
      OVER (PARTITION BY e.conv_id), 0) AS led
  FROM edits e LEFT JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.rn = e.rn
  WHERE e.edit <> 'D'
),
texts AS (
  SELECT conv_id, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY place) AS body
  FROM finals GROUP BY conv_id
)
SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal,
  CAST(substr(b.b, 1, 8) AS BIGINT) AS cost, substr(b.b, 9) AS audit,
  sha256(coalesce(t.body, '')) AS repaired_sha256
FROM best b LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""

TRIE = f"""
WITH {CRC},
filled AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role,
    sha256(length(role)::VARCHAR || ':' || role || text)) AS turns
  FROM filled GROUP BY conv_id
),
taken AS (
  SELECT o.conv_id, o.turns, f.turns AS head, ({_crc32("o.conv_id::VARCHAR")} % 6)::BIGINT AS h
  FROM crc_table, own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 100
),
whole AS (
  SELECT conv_id, list_concat(coalesce(head[1:h], []), turns[h + 1:]) AS turns FROM taken
),
members AS (
  SELECT conv_id, turns[1:d] AS node, d, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM whole)
),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, node[1:d - 1] AS above,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, d
),
children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above),
figures AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
    CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.node[n.d].text) END AS saves
  FROM nodes n LEFT JOIN children c ON c.node = n.node
),
sums AS (
  SELECT node[1:a] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM figures) GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
  s.n_leaves, s.saved_tokens, f.ends_sha256
FROM figures f JOIN sums s ON s.node = f.node
LEFT JOIN nodes p ON f.d > 0 AND p.node = f.above
"""
