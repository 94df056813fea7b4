"""DuckDB SQL of the registered queries, where SQL can express them on whole tables."""

from __future__ import annotations

_OP2 = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos,
         lower(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS low,
         regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(d.l) AS line, generate_subscripts(d.l, 1) AS pos) u
), keys AS (
  SELECT doc_id, line, pos, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS f FROM keys WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT keys.doc_id, keys.line, keys.pos, firsts.f IS NOT NULL AND keys.doc_id > firsts.f AS dropped
  FROM keys LEFT JOIN firsts ON keys.k = firsts.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""



def _crc32(number: str) -> str:
    """crc32 of the decimal digits of ``number``, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {byte}), 4294967295::BIGINT)"


_OP11 = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32('doc_id')} AS h FROM documents
), placed AS (
  SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS k FROM texts
), words AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // k) ELSE i END] AS word
  FROM placed, LATERAL (SELECT unnest(range(n)) AS i) u
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 1 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), found AS (
  SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := length, s := -start, p := -period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.p AS period,
       1000 * best.l // -best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(line, '')) AS collapsed_sha256
FROM documents d LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP13 = f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT *, ({_crc32('conv_id')} % 9)::BIGINT AS h FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(r.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN own r ON r.conv_id = c.conv_id - c.conv_id % 5
), prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS path, d = len(turns) AS ends FROM rebuilt, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d) u
), nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY path
), numbered AS (
  SELECT p.conv_id AS member, n.conv_id, n.depth, n.n_convs, n.path FROM prefixes p JOIN nodes n USING (path)
), links AS (
  SELECT DISTINCT a.conv_id AS top, a.depth AS top_depth, b.conv_id, b.depth, b.n_convs, b.path[b.depth].t AS t
  FROM numbered a JOIN numbered b ON a.member = b.member AND b.depth >= a.depth
), children AS (
  SELECT top AS conv_id, top_depth AS depth, count(*) FILTER (depth = top_depth + 1) AS n_children FROM links GROUP BY top, top_depth
)
SELECT n.conv_id, n.depth, any_value(p.conv_id) AS parent_conv_id, any_value(n.n_convs) AS n_convs, any_value(c.n_children) AS n_children,
       count(*) FILTER (k.n_children = 0) AS n_leaves,
       coalesce(sum((l.n_convs - 1) * octet_length(encode(l.t))), 0)::BIGINT AS saved_tokens, any_value(n.ends_sha256) AS ends_sha256
FROM nodes n JOIN children c USING (conv_id, depth)
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
JOIN links l ON l.top = n.conv_id AND l.top_depth = n.depth
JOIN children k ON k.conv_id = l.conv_id AND k.depth = l.depth
GROUP BY n.conv_id, n.depth
"""

ORACLE: dict[str, str] = {"op2_line_dedup": _OP2, "op11_periodic_runs": _OP11, "op13_prefix_trie": _OP13}
