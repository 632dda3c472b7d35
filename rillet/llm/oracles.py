"""DuckDB SQL of the queries that SQL can express."""

QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS (
  SELECT doc_id,
    regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
    length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM t),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM m WHERE len(ws) >= 5),
win AS (SELECT doc_id, i, ws[i:i + 4] AS k FROM pos),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win),
cov AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM dup, (SELECT unnest(range(0, 5)) AS j) WHERE n > 1 GROUP BY doc_id),
b AS (
  SELECT m.doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id),
f AS (
  SELECT *, (n_words < 10)::BIGINT * 1 + (100 * n_repeat_words > 20 * n_words)::BIGINT * 2
    + (100 * n_symbols > 25 * word_chars)::BIGINT * 4 + (100 * n_dup_lines > 50 * n_lines)::BIGINT * 8
    + (word_chars > 100 * n_words)::BIGINT * 16 + (100 * n_symbols > 10 * word_chars)::BIGINT * 32
    + (100 * n_dup_lines > 20 * n_lines)::BIGINT * 64 AS failed_bits
  FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 31) = 0 AS kept, failed_bits,
  CASE WHEN bit_count(failed_bits & 31) = 1 THEN failed_bits & 31 ELSE 0 END AS sole_bit,
  'standard-1' AS policy
FROM f
"""

NEAR_DEDUP = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM t WHERE len(ws) > 0 AND doc_id IS NOT NULL)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
  WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.doc_id, CASE WHEN t.doc_id IS NULL THEN len(list_distinct(list_transform(
    range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 1, 2) END), lambda i: array_to_string(ws[i:i + 2], ' '))))
  ELSE coalesce(n.n, 0) END::BIGINT AS n_shingles, coalesce(least(t.doc_id, m.c), t.doc_id) AS component_id,
  t.doc_id = coalesce(least(t.doc_id, m.c), t.doc_id) AS kept
FROM t LEFT JOIN n ON t.doc_id = n.doc_id
LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON t.doc_id = m.a
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
h AS (SELECT key, count(DISTINCT r) AS n, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key),
m AS (
  SELECT k.r, k.doc_id, k.line, k.i,
    h.key IS NOT NULL AND h.n >= 3 AND h.largest IS NOT NULL AND k.doc_id IS DISTINCT FROM h.largest AS gone
  FROM k LEFT JOIN h ON k.key = h.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

_LEAF = " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    for c in ("doc_id", "source", "lang", "n_chars", "{text}")
)

MERKLE = rf"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS r FROM documents),
c AS (  -- crc32 of the decimal id, bit by bit
  SELECT r, doc_id::VARCHAR AS s, 0 AS i, 4294967295::UBIGINT AS crc FROM d WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, s, i + 1, list_reduce(list_prepend(xor(crc, ord(s[i + 1])::UBIGINT), range(8)::UBIGINT[]),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)
  FROM c WHERE i < length(s)),
crc AS (SELECT r, xor(crc, 4294967295::UBIGINT) AS crc FROM c WHERE i = length(s)),
l AS (
  SELECT d.r, doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256({_LEAF.format(text="replace(text, chr(10), '')")})
      ELSE sha256({_LEAF.format(text="text")}) END AS given
  FROM d LEFT JOIN crc ON d.r = crc.r),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l),
n AS (  -- the nodes of every source's tree
  SELECT source, 0 AS lvl, rank AS i, leaf AS h FROM k
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS many FROM n) WHERE many > 1 GROUP BY source, lvl, i // 3),
top AS (SELECT source, max(lvl) AS height FROM n GROUP BY source),
s AS (
  SELECT n.source, h, height, row_number() OVER (ORDER BY n.source NULLS FIRST) - 1 AS i
  FROM n JOIN top ON n.source IS NOT DISTINCT FROM top.source AND lvl = height),
m AS (  -- the nodes above the sources
  SELECT 0 AS lvl, i, h FROM s
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS many FROM m) WHERE many > 1 GROUP BY lvl, i // 3),
root AS (SELECT h FROM m ORDER BY lvl DESC LIMIT 1),
f AS (  -- up from every leaf: the path's hash and the siblings so far
  SELECT k.r, k.source, 0 AS lvl, rank AS i, leaf AS h, given AS g, '' AS proof, false AS above FROM k
  UNION ALL
  SELECT f.r, f.source, any_value(CASE WHEN x.up THEN 0 ELSE x.lvl + 1 END), any_value(CASE WHEN x.up THEN x.i ELSE f.i // 3 END),
    any_value(x.parent), CASE WHEN any_value(x.up) THEN any_value(f.g) ELSE
      sha256(string_agg(CASE WHEN x.i = f.i THEN f.g ELSE x.h END, '' ORDER BY x.i)) END,
    any_value(f.proof) || CASE WHEN any_value(x.up) THEN '' ELSE coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i <> f.i), '') END,
    any_value(f.above OR x.up)
  FROM f JOIN (
    SELECT false AS above, n.source, n.lvl, n.i, n.h, '' AS parent, false AS up FROM n JOIN top ON n.source IS NOT DISTINCT FROM top.source AND lvl < height
    UNION ALL SELECT false, s.source, s.height, s.i, s.h, s.h, true FROM s
    UNION ALL SELECT true, NULL, lvl, i, h, '', false FROM m WHERE lvl < (SELECT max(lvl) FROM m)) x
  ON f.above = x.above AND f.lvl = x.lvl AND (f.above OR f.source IS NOT DISTINCT FROM x.source) AND (x.up OR f.i // 3 = x.i // 3)
  GROUP BY f.r, f.source),
e AS (SELECT r, g, proof FROM f WHERE above AND lvl = (SELECT max(lvl) FROM m))
SELECT k.doc_id, k.leaf, s.h AS subroot, root.h AS root, sha256(e.proof) AS proof_sha256, e.g AS folded_root,
  e.g = root.h AS verified
FROM k JOIN e ON k.r = e.r JOIN s ON k.source IS NOT DISTINCT FROM s.source, root
"""


def _least(*items: str) -> str:
    return f"list_sort([{', '.join(items)}])[1]"


def _more(item: str, cost: str, letter: str, turn: str = "''") -> str:
    """An item after one edit; turns are joined by line ends."""
    return f"{{'c': {item}.c + {cost}, 'a': {item}.a || '{letter}', 't': {item}.t || {turn}}}"


_NEVER = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
_STAY = "CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 5 ELSE 0 END"
_KEEP = "chr(10) || role || ':' || text"


def _keep(item: str, initial: str) -> str:
    return f"CASE WHEN left(role, 1) = '{initial}' THEN {_more(item, _STAY, 'K', _KEEP)} ELSE {_NEVER} END"


def _rerole(item: str, due: str) -> str:
    return _more(item, f"{_STAY} + 1", "R", f"chr(10) || '{due}:' || text")


#: States: e0 start, e1 after the system turn, e2 after a user's, e3 after an assistant's.
_TO_USER = [f(x) for x in ("e0", "e1", "e3") for f in (lambda e: _keep(e, "u"), lambda e: _rerole(e, "user"))]

REPAIR = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
c AS (  -- crc32 of each name, bit by bit
  SELECT name, 0 AS i, 4294967295::UBIGINT AS crc FROM (SELECT DISTINCT name FROM src)
  UNION ALL
  SELECT name, i + 1, list_reduce(list_prepend(xor(crc, ord(name[i + 1])::UBIGINT), range(8)::UBIGINT[]),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)
  FROM c WHERE i < length(name)),
kinds AS (SELECT name, xor(crc, 4294967295::UBIGINT) % 20 AS kind FROM c WHERE i = length(name)),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
  FROM src JOIN kinds USING (name)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
  FROM d),
r AS (
  SELECT *, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
    CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM o),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE fault = 1)::BIGINT AS blank, count(*) FILTER (WHERE fault = 2)::BIGINT AS duplicate,
    count(*) FILTER (WHERE fault = 3)::BIGINT AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM r GROUP BY conv_id),
w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS e0, {_NEVER} AS e1, {_NEVER} AS e2, {_NEVER} AS e3
  FROM src
  UNION ALL
  SELECT conv_id, i + 1, {_more('e0', '2', 'D')}, {_least(_more('e1', '2', 'D'), _keep('e0', 's'))},
    {_least(_more('e2', '2', 'D'), *_TO_USER)}, {_least(_more('e3', '2', 'D'), _keep('e2', 'a'), _rerole('e2', 'assistant'))}
  FROM (
    SELECT p.conv_id, p.i, e0, e1, e2, {_least('e3', _more('e2', '5', 'I', "chr(10) || 'assistant:'"))} AS e3, role, text, fault
    FROM (
      SELECT w.conv_id, w.i, e0, e1, e3,
        {_least('e2', *[_more(x, '5', 'I', "chr(10) || 'user:'") for x in ('e0', 'e1', 'e3')])} AS e2
      FROM w) p
    JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1)),
z AS (
  SELECT conv_id, e0, {_least('e3', _more('e2', '5', 'I', "chr(10) || 'assistant:'"))} AS e3 FROM (
    SELECT conv_id, e0, e3, {_least('e2', *[_more(x, '5', 'I', "chr(10) || 'user:'") for x in ('e0', 'e1', 'e3')])} AS e2
    FROM w QUALIFY i = max(i) OVER (PARTITION BY conv_id)))
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, {_least('e0', 'e3')}.c AS cost,
  {_least('e0', 'e3')}.a AS audit, sha256(substr({_least('e0', 'e3')}.t, 2)) AS repaired_sha256
FROM z LEFT JOIN n ON z.conv_id IS NOT DISTINCT FROM n.conv_id
"""

ORACLES: dict[str, str] = {
    "op12_conversation_repair": REPAIR,
    "op11_merkle_manifest": MERKLE,
    "op13_line_dedup": LINE_DEDUP,
    "op2_topk_search": TOP_K,
    "op5_near_dedup": NEAR_DEDUP,
    "op1_quality_rules": QUALITY,
}
