"""DuckDB SQL for the operators' queries that SQL can express.

Not expressible: op2 (tokenisation), op4 (BLAKE2b vectors), op6 (vocabulary file), op7 (compression), op8
(keyed permutation) and op9 (HTML text); these are tested against brute force or exact round trips.
"""

from __future__ import annotations

from .decontaminate import LEAST, NAME, NUMBER, POINT, UNIT, UNITS

_GAP = r"[\x00-\x20!-/:-@\[-`{-\x7f]"


def _words(text: str) -> str:
    # RE2 has no look-around: digits on both sides are matched, twice as they may be shared.
    once = rf"regexp_replace({text}, '([0-9])[.,]([0-9])', '\1{POINT}\2', 'g')"
    return f"list_filter(regexp_split_to_array(regexp_replace({once}, '([0-9])[.,]([0-9])', '\\1{POINT}\\2', 'g'), '{_GAP}+'), lambda x: x <> '')"


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS.split())


def _windows(table: str, key: str) -> str:
    """key, pos, w and p (words and placeholders), a and t (caseless and typed form; t null where it doesn't count)."""
    number = "(low[{0}] >= '0' AND low[{0}] < ':')"
    kind = f"CASE WHEN {number.format('k')} THEN '{NUMBER}' WHEN k > 1 AND {number.format('k - 1')} AND low[k] IN ({_UNIT_LIST}) THEN '{UNIT}' WHEN low[k] <> as_is[k] THEN '{NAME}' ELSE '' END"
    return f"""SELECT *, CASE WHEN len(list_filter(p, lambda x: x <> '{NUMBER}')) = 0 THEN w ELSE list_transform(range(1, 6), lambda k: CASE WHEN p[k] = '{NUMBER}' THEN p[k] ELSE w[k] END) END AS a,
    CASE WHEN len(list_filter(p, lambda x: x IN ('{UNIT}', '{NAME}'))) > 0 AND len(list_filter(p, lambda x: x = '')) >= 2 THEN list_transform(range(1, 6), lambda k: CASE WHEN p[k] = '' THEN w[k] ELSE p[k] END) END AS t
  FROM (SELECT {key}, i AS pos, low[i + 1:i + 5] AS w, kinds[i + 1:i + 5] AS p FROM (SELECT {key}, low, kinds, unnest(range(0, len(low) - 4)) AS i
    FROM (SELECT {key}, low, list_transform(range(1, len(low) + 1), lambda k: {kind}) AS kinds FROM (SELECT {key}, as_is, list_transform(as_is, lambda x: lower(x)) AS low FROM (SELECT {key}, {_words("coalesce(text, '')")} AS as_is FROM {table})))))"""


_OP1 = f"""WITH b0 AS ({_windows('benchmark', 'item_id')}), d0 AS ({_windows('documents', 'doc_id')}),
total AS (SELECT item_id, count(DISTINCT a) AS item_windows FROM b0 GROUP BY 1),
b AS (SELECT item_id, w, p, a, f, min(pos) AS pos FROM (SELECT *, unnest(CASE WHEN t IS NULL THEN [a] ELSE [a, t] END) AS f FROM b0) GROUP BY ALL),
d AS (SELECT doc_id, pos, w, unnest(CASE WHEN t IS NULL THEN [a] ELSE [a, t] END) AS f FROM d0),
hits AS (SELECT d.doc_id, b.item_id, d.pos - b.pos AS diagonal, b.a AS a,
  list_filter(list_transform(range(1, 6), lambda k: CASE WHEN b.p[k] <> '' THEN {{'item': b.p[k] || b.w[k], 'doc': b.p[k] || d.w[k]}} END), lambda s: s IS NOT NULL) AS slots FROM d JOIN b ON d.f = b.f),
entries AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, CASE WHEN len(slots) > 0 THEN diagonal END AS line, a, slots FROM hits),
pairs AS (SELECT doc_id, item_id, line, s.item AS item, s.doc AS doc, count(*) AS n FROM (SELECT doc_id, item_id, line, unnest(slots) AS s FROM entries) GROUP BY ALL),
lost AS (SELECT DISTINCT x.doc_id, x.item_id, x.line, x.item, x.doc FROM pairs x JOIN pairs y USING (doc_id, item_id, line, item) WHERE x.item <> x.doc AND (y.n > x.n OR y.n = x.n AND y.doc <> x.doc AND (y.doc = y.item OR y.doc > x.doc))),
dropped AS (SELECT DISTINCT e.doc_id, e.item_id, e.line, e.a, e.slots FROM (SELECT *, unnest(slots) AS s FROM entries) e JOIN lost l ON l.doc_id = e.doc_id AND l.item_id = e.item_id AND l.line = e.line AND l.item = e.s.item AND l.doc = e.s.doc),
kept AS MATERIALIZED (SELECT * FROM entries e ANTI JOIN dropped USING (doc_id, item_id, line, a, slots)),
cover AS (SELECT doc_id, item_id, count(DISTINCT a) AS n_windows FROM kept GROUP BY ALL),
sizes AS (SELECT doc_id, item_id, max(n) AS n_slots, max(c) AS n_changed FROM (SELECT doc_id, item_id, line, count(DISTINCT s) AS n, count(DISTINCT s) FILTER (WHERE s.item <> s.doc) AS c FROM (SELECT doc_id, item_id, line, unnest(slots) AS s FROM kept) GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, n_windows, item_windows, n_windows / item_windows::DOUBLE AS coverage, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed
FROM cover JOIN total USING (item_id) LEFT JOIN sizes USING (doc_id, item_id) WHERE n_windows / item_windows::DOUBLE >= {LEAST}"""

_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: the text between matches gives their places."""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s, length(whole[k]) AS n
  FROM (SELECT doc_id, gaps, whole, checked, unnest(range(1, len(whole) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS whole,
    regexp_extract_all(text, '{pattern}', {group}) AS checked FROM docs)) WHERE length(checked[k]) >= {least}"""


_OP3 = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_found(0, 'assign', _ASSIGN, 2, 8)} UNION ALL {_found(1, 'access', 'AKIA[A-Z0-9]+', 0, 16)} UNION ALL {_found(2, 'hex', '[0-9a-f]+', 0, 32)}
 UNION ALL {_found(3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0)} UNION ALL {_found(4, 'forge', 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 0)}),
named AS (SELECT *, kind || ':' || s || ':' || (s + n) AS x FROM found),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(x, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(x, ',' ORDER BY s, rank) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN by_doc USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP5 = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS at FROM documents UNION SELECT r.id, e.y FROM reach r JOIN edges e ON r.at = e.x)
SELECT r.id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.at) AS component_id, min(r.at) = r.id AS kept FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.id GROUP BY r.id"""

_OP10 = """WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM (SELECT unnest([0, 1]) AS t)),
pieces AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before, length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + sum(CASE WHEN before IS NULL THEN 12 + length(role) + 1 WHEN before = role THEN 10 ELSE 11 + 12 + length(role) + 1 END) + 11)::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_template_decontamination": _OP1,
    "op3_blob_ledger_secrets": _OP3,
    "op5_setsketch_near_duplicates": _OP5,
    "op10_relational_chat": _OP10,
}
