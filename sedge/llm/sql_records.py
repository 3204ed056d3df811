"""DuckDB SQL of the queries over archives and conversations."""

from __future__ import annotations

_BLANK = r"[^\x20\x09-\x0D]"


def _crc32(key: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})"
    codes = f"list_prepend(4294967295, list_transform(string_split({key}, ''), lambda z: ord(z)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}), 4294967295)"


def _edit(way: str, price: int | str, initial: str, turn: str = "") -> str:
    """The way (cost, audit, repaired) after one more edit that appends `turn`."""
    repaired = f"CASE WHEN {way}.r IS NULL THEN {turn} ELSE {way}.r || chr(10) || {turn} END" if turn else f"{way}.r"
    return f"{{'c': {way}.c + {price}, 'a': {way}.a || '{initial}', 'r': {repaired}}}"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _inserts(from_: str) -> str:
    """Inserts after a turn, or before the first."""
    user = _least("s2", *(_edit(s, 5, "I", "'user:'") for s in ("s0", "s1", "s3")))
    return f"SELECT conv_id, pos, s0, s1, u AS s2, {_least('s3', _edit('u', 5, 'I', chr(39) + 'assistant:' + chr(39)))} AS s3 FROM (SELECT *, {user} AS u FROM ({from_}))"


def _turn(ways: tuple[str, ...], initial: str, name: str) -> list[str]:
    """Keep a turn of the role that comes next, rerole any other."""
    whole, renamed = "role || ':' || text", f"'{name}:' || text"
    return [f"CASE WHEN fault IN (1, 2) THEN NULL WHEN i = '{initial}' THEN {_edit(w, 'more', 'K', whole)} ELSE {_edit(w, '(more + 1)', 'R', renamed)} END" for w in ways]


_STEP = f"""
SELECT d.conv_id, f.pos, {_edit('s0', 2, 'D')} AS s0,
       {_least(_edit('s1', 2, 'D'), "CASE WHEN fault NOT IN (1, 2) AND i = 's' THEN " + _edit('s0', 'more', 'K', "role || ':' || text") + " END")} AS s1,
       {_least(_edit('s2', 2, 'D'), *_turn(('s0', 's1', 's3'), 'u', 'user'))} AS s2,
       {_least(_edit('s3', 2, 'D'), *_turn(('s2',), 'a', 'assistant'))} AS s3
FROM dp d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = d.pos + 1"""

_FAR = "{'c': 1000000000, 'a': '', 'r': NULL::VARCHAR}"

OP13 = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
l AS (SELECT *, {_crc32("key")} % 20 AS lot FROM k),
d AS (
  SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE lot WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM l WHERE lot <> 0),
p AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM p),
g AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_BLANK}') THEN 1 WHEN seen > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM o),
f AS (SELECT *, CASE fault WHEN 3 THEN 5 ELSE 0 END AS more FROM g),
dp AS (
  {_inserts(f"SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 'r': NULL::VARCHAR}} AS s0, {_FAR} AS s1, {_FAR} AS s2, {_FAR} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)")}
  UNION ALL {_inserts(_STEP)}),
n AS (
  SELECT conv_id, max(pos) AS n, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || i NOT IN ('su', 'ua', 'au')) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
e AS (
  SELECT dp.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
         coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, {_least('s0', 's3')} AS way
  FROM dp LEFT JOIN n ON dp.conv_id IS NOT DISTINCT FROM n.conv_id WHERE dp.pos = coalesce(n.n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, way.c::BIGINT AS cost, way.a AS audit, sha256(coalesce(way.r, '')) AS repaired_sha256 FROM e
"""



def _base32(digest: str) -> str:
    """Base32 of a hexadecimal SHA-1, five hexadecimal digits (four letters) at a time."""
    bits = f"('0x' || substr({digest}, 5 * g + 1, 5))::BIGINT"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({bits}) >> {shift}) & 31)::INT + 1, 1)" for shift in (15, 10, 5, 0))
    return f"list_aggregate(list_transform(range(8), lambda g: {letters}), 'string_agg', '')"


OP11 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS digest FROM p),
r AS (
  SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS keeper FROM d
  WINDOW w AS (PARTITION BY digest, payload_bytes ORDER BY page_id DESC NULLS LAST, url NULLS FIRST))
SELECT page_id, payload_bytes, {_base32("digest")} AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN keeper END AS refers_to FROM r
"""

OP12 = rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list({{'t': role || chr(0) || text, 'w': len(regexp_extract_all(text, '{_BLANK}+'))}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM k GROUP BY conv_id),
r AS (
  SELECT o.conv_id, o.turns, coalesce(b.turns, []) AS base, {_crc32("o.conv_id::VARCHAR")} % 4 AS h
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
s AS (SELECT conv_id, list_concat(list_slice(base, 1, h), list_slice(turns, h + 1, len(turns))) AS turns FROM r),
p AS (
  SELECT conv_id, d, sha256(array_to_string(list_transform(list_slice(turns, 1, d), lambda t: sha256(t.t)), ',')) AS node,
         sha256(array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda t: sha256(t.t)), ',')) AS parent,
         CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS words, d = len(turns) AS ends
  FROM s, unnest(range(0, len(turns) + 1)) AS x(d)),
n AS (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM p GROUP BY d, node),
c AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, node)),
t AS (
  SELECT u.d, u.node, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
  FROM m JOIN p v ON v.conv_id = m.conv_id AND v.d = m.d JOIN p u ON u.conv_id = v.conv_id AND u.d <= v.d GROUP BY u.d, u.node)
SELECT m.conv_id, m.d::BIGINT AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, t.n_leaves::BIGINT AS n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, sha256(m.ids) AS ends_sha256
FROM m JOIN t USING (d, node) LEFT JOIN m a ON m.d > 0 AND a.d = m.d - 1 AND a.node = m.parent
"""

RECORDS_SQL = {
    "op11_warc_source": OP11,
    "op12_ternary_prefix_trie": OP12,
    "op13_bidirectional_repair": OP13,
}
