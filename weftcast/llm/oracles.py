"""DuckDB SQL for the operators that SQL expresses."""

from __future__ import annotations

from .secret_scan import ALLOWED, CANDIDATE, CLASSES, MIN_ASSIGNED, TERMS, WINDOW, bound

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(name: str, rank: int, pattern: str, keep: str, table: str = "docs") -> str:
    """One row for each match, its begin from the lengths of the pieces and matches before it."""
    p = quoted(pattern)
    return f"""{name}_raw AS (
  SELECT row_id, doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS found FROM {table} WHERE regexp_matches(t, {p})),
{name} AS (
  SELECT row_id, {rank} AS rank, b AS b, b + length(f) AS e, f FROM (
    SELECT row_id, f, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b
    FROM (SELECT row_id, gaps, found, unnest(found) AS f, generate_subscripts(found, 1) AS i FROM {name}_raw)) WHERE {keep})"""


SECRETS = f"""WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
{matches("assign", 0, ASSIGN, f"length(regexp_extract(f, {quoted(ASSIGN)}, 2)) >= {MIN_ASSIGNED}")},
{matches("access", 1, "AKIA[A-Z0-9]+", "length(f) >= 18")},
{matches("hexes", 2, "[0-9a-f]{16,}", "true")},
base AS (SELECT row_id, rank, b, e FROM assign UNION ALL SELECT row_id, rank, b, e FROM access UNION ALL SELECT row_id, rank, b, e FROM hexes),
{matches("candidates", 3, CANDIDATE, "regexp_matches(f, '[0-9]') AND regexp_matches(f, '[A-Za-z]') AND NOT regexp_matches(f, " + quoted("|".join(f"({a})" for a in ALLOWED)) + ")")},
windows AS (
  SELECT row_id, b, f, i, substr(f, i, {WINDOW}) AS w,
    CASE WHEN regexp_matches(f, '{CLASSES[0][1]}') THEN {bound(CLASSES[0][2])} WHEN regexp_matches(f, '{CLASSES[1][1]}') THEN {bound(CLASSES[1][2])} ELSE {bound(CLASSES[2][2])} END AS most
  FROM (SELECT row_id, b, f, unnest(range(1, length(f) - {WINDOW - 2})) AS i FROM candidates)),
hot AS (
  SELECT row_id, b + min(i) - 1 AS b, b + max(i) - 1 + {WINDOW} AS e FROM windows
  WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: {TERMS}[length(w) - length(replace(w, c, '')) + 1])) <= most GROUP BY row_id, b, f),
added AS (SELECT h.row_id, 3 AS rank, h.b, h.e FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.row_id = h.row_id AND s.b <= h.b AND h.e <= s.e)),
spans AS (SELECT row_id, rank, b, ['assign', 'access', 'hex', 'entropy'][rank + 1] || ':' || b || ':' || e AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
per AS (SELECT row_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg(s, ',' ORDER BY b, rank) FILTER (rank < 3), '') AS base, string_agg(s, ',' ORDER BY b, rank) AS spans FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (row_id)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The table of CRC-32, by its polynomial.
CRC_TABLE = "crc_table AS (SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS crc FROM range(256) AS t(i))"


def crc32(code_points: str) -> str:
    """CRC-32 of the UTF-8 bytes of a list of code points below U+0100; column crc is the table."""
    octets = f"flatten(list_transform({code_points}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


LINES = f"""WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT row_id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, {ASCII_SPACE}), '{UPPER}', '{LOWER}') AS key FROM split),
common AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) >= 3),
marked AS (SELECT row_id, doc_id, line, i, common.key IS NOT NULL AND doc_id IS DISTINCT FROM top AS gone FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY row_id, doc_id"""

SPELLING = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, n, {crc32("list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: unicode(x))")} AS h FROM runs, crc_table),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed),
words AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
parts AS (SELECT w, i, length(w) AS size, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT p.w AS a, s.w AS b FROM parts p JOIN words s ON p.rest = s.w),
pairs AS (SELECT DISTINCT p.w AS a, q.w AS b FROM parts p JOIN parts q ON p.i = q.i AND p.rest = q.rest AND p.size = q.size WHERE p.w <> q.w UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
near AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS best, max(n) AS best_n FROM pairs JOIN words ON w = b GROUP BY a),
formed AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near ON a = w),
chain AS (SELECT w, coalesce(form, w) AS at, form IS NULL AS done FROM formed UNION ALL SELECT c.w, coalesce(f.form, c.at), f.form IS NULL FROM chain c JOIN formed f ON f.w = c.at WHERE NOT c.done)
SELECT f.w AS word, form, c.at AS root, n, n_near, form_n FROM formed f JOIN chain c ON c.w = f.w AND c.done"""


def edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state {c, a, t} of the search after one more edit: cost, audit and repaired lines, each after a newline."""
    lines = f"{state}.t" if line is None else f"{state}.t || chr(10) || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}}"


def cheapest(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def when(condition: str, state: str) -> str:
    return f"CASE WHEN {condition} THEN {state} ELSE none END"


ROW = "role || ':' || text"
REPAIR = f"""WITH RECURSIVE {CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: unicode(x))")} % 20 AS kind FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM given WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER conv AS pos, lag(role[1]) OVER conv AS before, right(rtrim(text, {ASCII_SPACE}), 1) AS last FROM damaged WINDOW conv AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy)),
judged AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
search AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS e, none AS s, none AS u, none AS a, none FROM (SELECT DISTINCT conv_id FROM damaged), (SELECT {{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}} AS none)
  UNION ALL
  SELECT conv_id, pos, {edit("e", "3", "D")}, {cheapest(edit("s", "3", "D"), when("NOT bad AND role[1] = 's'", edit("e", "more", "K", ROW)))},
    {cheapest(edit("u", "3", "D"), *(when("NOT bad AND role[1] = 'u'", edit(x, "more", "K", ROW)) for x in "esa"), *(when("NOT bad", edit(x, "2 + more", "R", "'user:' || text")) for x in "esa"))},
    {cheapest(edit("a", "3", "D"), when("NOT bad AND role[1] = 'a'", edit("u", "more", "K", ROW)), when("NOT bad", edit("u", "2 + more", "R", "'assistant:' || text")))}, none
  FROM (SELECT * EXCLUDE (b), {cheapest("b", edit("u", "2", "I", "'assistant:'"))} AS a FROM (
    SELECT p.conv_id, r.pos, p.e, p.s, {cheapest("p.u", *(edit(f"p.{x}", "2", "I", "'user:'") for x in "esa"))} AS u, p.a AS b, p.none, r.role, r.text, coalesce(r.fault IN ('blank', 'duplicate'), false) AS bad, CAST(coalesce(r.fault = 'truncated', false) AS BIGINT) AS more
    FROM search p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1))),
ends AS (SELECT search.* FROM search JOIN (SELECT conv_id, max(pos) AS pos FROM judged GROUP BY conv_id) m ON search.conv_id IS NOT DISTINCT FROM m.conv_id AND search.pos = m.pos),
final AS (SELECT conv_id, {cheapest("e", "a", edit("u", "2", "I", "'assistant:'"), edit("s", "4", "II", "'user:' || chr(10) || 'assistant:'"))} AS best FROM ends)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM i.conv_id"""

ORACLE: dict[str, str] = {"op7_secret_scan": SECRETS, "op11_turn_repair": REPAIR, "op12_spelling": SPELLING, "op13_line_dedup": LINES}
