"""Conversation structure repair as DuckDB SQL: a recursive fold, turn by turn, over strings of ten digits of cost, the
audit and, behind chr(1), the lines kept. Such strings order by cost and then audit."""

from __future__ import annotations

#: The 256 remainders of crc32's reversed polynomial, by shifting each byte eight times.
CRC_TABLE = "(SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"


def crc32(text: str) -> str:
    """Unsigned crc32 of a string's UTF-8 bytes; tab from CRC_TABLE must be in scope."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _then(state: str, cost: str, letter: str, line: str = "''") -> str:
    head, rest = f"split_part({state}, chr(1), 1)", f"substr({state}, strpos({state}, chr(1)))"
    return f"lpad((left({head}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({head}, 11) || '{letter}' || {rest} || {line}"


def repair_sql() -> str:
    """The rows of repair() over the table conversations."""
    w = "(PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, place)"
    start, never = "'0000000000' || chr(1)", "'5000000000' || chr(1)"
    insert_user, insert_assistant = (lambda s: _then(s, "2", "I", "chr(10) || 'user:'")), (lambda s: _then(s, "2", "I", "chr(10) || 'assistant:'"))
    closed_user = f"least(u0, {insert_user('n0')}, {insert_user('s0')}, {insert_user('a0')})"
    keep = _then
    row = "chr(10) || r.role || ':' || r.text"
    moved = lambda source, initial, role: f"CASE WHEN r.must THEN NULL WHEN r.initial = '{initial}' THEN {keep(source, 'r.extra', 'K', row)} ELSE {keep(source, 'r.extra + 2', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || r.text')} END"
    before = "least(f.n, f.s, f.a)"
    return f"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS place
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, {CRC_TABLE} t)
  WHERE kind <> 0),
faults AS (
  SELECT *, row_number() OVER {w} AS i, lag(left(role, 1)) OVER {w} || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, place) > 1 AS again
  FROM damaged),
turns AS (
  SELECT *, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::INT AS extra
  FROM (SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM faults)),
summary AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id),
fold AS (
  SELECT conv_id, 0 AS i, n0 AS n, s0 AS s, {closed_user} AS u, least(a0, {insert_assistant(closed_user)}) AS a
  FROM (SELECT conv_id, {start} AS n0, {never} AS s0, {never} AS u0, {never} AS a0 FROM summary)
  UNION ALL
  SELECT conv_id, i, n0, s0, {closed_user}, least(a0, {insert_assistant(closed_user)}) FROM (
    SELECT f.conv_id, r.i, {keep('f.n', '3', 'D')} AS n0,
      least({keep('f.s', '3', 'D')}, CASE WHEN NOT r.must AND r.initial = 's' THEN {keep('f.n', 'r.extra', 'K', row)} END) AS s0,
      least({keep('f.u', '3', 'D')}, {moved(before, 'u', 'user')}) AS u0, least({keep('f.a', '3', 'D')}, {moved('f.u', 'a', 'assistant')}) AS a0
    FROM fold f JOIN turns r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1)),
best AS (SELECT s.*, least(f.n, f.a) AS best FROM summary s JOIN fold f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.n = f.i)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(left(best, 10)::BIGINT, 0) AS cost, coalesce(substr(split_part(best, chr(1), 1), 11), '') AS audit, sha256(coalesce(substr(best, strpos(best, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN best b ON k.conv_id IS NOT DISTINCT FROM b.conv_id"""
