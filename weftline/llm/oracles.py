"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, '') AS k,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM t),
l AS (
  SELECT *, cap / weight AS r,
         ((SELECT sum(source_size)::DOUBLE FROM t) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
g AS (SELECT max(level) AS level FROM l),
p AS (SELECT source, source_size, round(least(cap, coalesce(g.level, 'infinity'::DOUBLE) * weight), 6) AS target FROM w, g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p),
m AS (
  SELECT s.*, e.source_size, e.target, e.whole, row_number() OVER (PARTITION BY s.source ORDER BY u, k) AS rn
  FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source),
r AS (
  SELECT m.*, CASE WHEN size <= target - whole * source_size THEN 1 ELSE 0 END AS more, target - whole * source_size AS gap
  FROM m WHERE rn = 1
  UNION ALL
  SELECT m.*, CASE WHEN m.size <= r.gap - r.more * r.size THEN 1 ELSE 0 END, r.gap - r.more * r.size
  FROM r JOIN m ON m.source IS NOT DISTINCT FROM r.source AND m.rn = r.rn + 1)
SELECT doc_id, size, source_size, target, size * (whole + more) AS taken
FROM r
"""

#: CRC-32 byte by byte with a table made by its rule; shards by the middle byte of each row in order.
OP2 = """
WITH tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda acc, x: CASE WHEN acc & 1 = 1 THEN xor(3988292384, acc >> 1) ELSE acc >> 1 END) ORDER BY n) AS tab FROM range(256) r(n)),
t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, (len(h) // 2 + 1)::BIGINT AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1])))::BIGINT AS text_crc32
  FROM t, tab),
o AS (SELECT *, 2 * sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS middle, 2 * sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(15, middle * 16 // total)::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, and everything that links reach.
OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS shingle FROM s),
n AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM s),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM x JOIN x y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM n LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) ON a = doc_id
"""

#: Every 50-byte window, with the least document that holds it; windows of later documents go, in runs.
OP9 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM t WHERE len(h) >= 100)),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS low FROM w) WHERE low < doc_id),
e AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY 1, 2),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT t.doc_id, t.h, sum(b - a)::BIGINT AS removed, count(*)::BIGINT AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
      FROM c JOIN t USING (doc_id) GROUP BY 1, 2)
SELECT t.doc_id, (len(t.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, t.h))) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""

#: The patterns of the contract, as in secrets.py.
_KINDS = (
    ("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "len(v) >= 8"),
    ("access", 1, "AKIA[A-Z0-9]+", 0, "len(v) >= 16"),
    ("hex", 2, "[0-9a-f]+", 0, "len(v) >= 32"),
    ("own", 3, "[A-Za-z0-9+/_-]+", 0, "len(v) >= 20 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"),
)


def _spans(kind: str, rank: int, pattern: str, group: int, wanted: str) -> str:
    """Matches with their places: a match starts behind all pieces and matches before it."""
    return f"""SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, v, start, start + len(m) AS stop FROM (
      SELECT doc_id, source, unnest(ms) AS m, unnest(vs) AS v, unnest(list_transform(range(1, len(ms) + 1), lambda i: (list_sum(list_transform(bs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::BIGINT)) AS start
      FROM (SELECT doc_id, source, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS bs
            FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents) WHERE regexp_matches(text, '{pattern}'))) WHERE {wanted}"""


OP10 = f"""
WITH a AS MATERIALIZED ({' UNION ALL '.join(_spans(*k) for k in _KINDS)}),
f AS MATERIALIZED (SELECT * FROM a WHERE kind <> 'own' UNION ALL SELECT * FROM a o WHERE kind = 'own' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.kind <> 'own' AND b.doc_id = o.doc_id AND b.start < o.stop AND o.start < b.stop)),
u AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT doc_id) AS places FROM f GROUP BY v),
j AS (SELECT f.*, owners <= 1 AND places <= 5 AS live, kind || ':' || start || ':' || stop AS shown FROM f JOIN u USING (v)),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(shown, ',' ORDER BY start, rank, stop) FILTER (kind <> 'own') AS base, string_agg(shown, ',' ORDER BY start, rank, stop) AS spans, count(*) FILTER (live) AS n_live
  FROM j WHERE kind <> 'own' OR live GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id
"""

#: OP2 is for the tests: its column of nulls has no type that all readers agree on.
ORACLES: dict[str, str] = {"op1_mix_sources": OP1, "op6_ngram_join": OP6, "op9_suffix_array": OP9, "op10_secrets": OP10}
