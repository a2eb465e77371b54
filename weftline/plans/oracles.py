"""DuckDB SQL for the registered queries: an independent statement of each result."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _uuid(text: str) -> str:
    return rf"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


def _stamp(number: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_hours(({number})::INTEGER))"


#: Percent-encoded path of a root-relative target: bytes that a path may not hold, one by one.
_ENCODED = r"list_aggregate(list_transform(string_split(h, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9\-._~$&+,/:;=@%!''()*]$') THEN c WHEN c = ' ' THEN '%20' ELSE url_encode(c) END), 'string_agg', '')"

#: The patterns of functions/html.py and functions/urls.py stand here and below as RE2 takes them.
PAGES = rf"""
p AS (SELECT page_id, url, html, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site,
      regexp_extract_all(html, '(?i)<a.*?href\s*?=\s*?"\s*?(.*?)\s*?".*?>', 1) AS hrefs FROM pages),
a0 AS (SELECT page_id, url, site, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS i FROM p),
a1 AS (SELECT page_id, url, i, site || {_ENCODED} AS link FROM a0 WHERE h LIKE '/%' AND h NOT LIKE '//%'),
a2 AS (SELECT page_id, url, link, min(i) AS i FROM a1 WHERE NOT regexp_matches(link, '(?i)\.(?:jpg|jpeg|png|gif|ico|css|js)$') GROUP BY 1, 2, 3),
a AS (SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordinal FROM a2)"""

LINKS = f"l AS (SELECT {_uuid('url')} AS id, url, {_stamp('page_id % 500')} AS retrieved_at FROM pages)"
EDGES = f"""
e0 AS (SELECT {_uuid('url')} AS src, {_uuid('link')} AS dst, max({_stamp('page_id % 500')}) AS updated_at FROM a GROUP BY 1, 2),
e AS (SELECT {_uuid('src || dst')} AS id, src, dst, updated_at FROM e0)"""
GRAPH = f"""{PAGES}, {LINKS}, {EDGES},
g AS (SELECT {_uuid('url')} AS id, url, max(t) AS retrieved_at
      FROM (SELECT url, retrieved_at AS t FROM l UNION ALL SELECT link, TIMESTAMP '0001-01-01 00:00:00' FROM a) GROUP BY url)"""
PARTS = """
b AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem),
e AS (SELECT p AS src, s AS dst FROM b UNION ALL SELECT s, p FROM b),
v AS (SELECT DISTINCT src AS id FROM e)"""
DOCS = f"""
d AS (SELECT {_uuid('doc_id::VARCHAR')} AS link_id, 'http://' || source || '.example.org/' || doc_id AS url, '' AS title, text AS content,
      {_stamp('doc_id % 500')} AS indexed_at, (doc_id * 7919) % 1009 / 1009.0::DOUBLE AS pagerank FROM documents)"""
TERMS = ("stupid", "idiot", "pathetic")
TOKENS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"
HIT = f"list_has_any({TOKENS}, ['stupid', 'idiot', 'pathetic'])"


def _bounds(n: int) -> list[str]:
    width = (1 << 128) // n
    return [f"{width * i:032x}" for i in range(1, n)]


def _part(n: int) -> str:
    return " + ".join(f"(replace(id, '-', '') >= '{b}')::INTEGER" for b in _bounds(n))


def _ranks(prefix: str, vertices: str, steps: int) -> str:
    """PageRank unrolled: e has src, dst; `vertices` has id."""
    parts = [
        f"WITH {prefix}",
        f"x AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT id FROM {vertices}) AND dst IN (SELECT id FROM {vertices}))",
        "o AS MATERIALIZED (SELECT src, count(*) AS deg FROM x GROUP BY src)",
        f"n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM {vertices})",
        f"r1 AS MATERIALIZED (SELECT id, 1 / (SELECT n FROM n) AS rank FROM {vertices})",
    ]
    for k in range(2, steps):
        parts.append(
            f"c{k} AS MATERIALIZED (SELECT x.dst, sum(r.rank / o.deg) AS s FROM x JOIN o USING (src) JOIN r{k - 1} r ON r.id = x.src GROUP BY x.dst)"
        )
        parts.append(f"z{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) / (SELECT n FROM n) AS s FROM r{k - 1} WHERE id NOT IN (SELECT src FROM o))")
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT id, 0.15::DOUBLE / (SELECT n FROM n) + 0.85::DOUBLE * (SELECT s FROM z{k}) + 0.85::DOUBLE * coalesce(c.s, 0) AS rank "
            f"FROM r{k - 1} LEFT JOIN c{k} c ON c.dst = id)"
        )
    return ",\n".join(parts) + f"\nSELECT id, round(rank, 9) AS rank FROM r{steps - 1}"


def _bm25() -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(TERMS)))
    idf = lambda k: f"ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE))"
    score = " + ".join(f"{idf(k)} * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))" for k in range(len(TERMS)))
    return f"""{DOCS},
t0 AS (SELECT link_id, pagerank, {TOKENS} AS t FROM d),
t1 AS (SELECT link_id, pagerank, len(t) AS length, {tf} FROM t0),
s AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM t1),
q AS (SELECT link_id, pagerank, {score} AS score FROM t1, s WHERE {' OR '.join(f'tf{k} > 0' for k in range(len(TERMS)))})"""


def _converged(prefix: str, vertices: str, columns: str = "id, round(rank, 9) AS rank", rest: str = "") -> str:
    """PageRank until the sum of changes is under 0.001. The first step has 1 / N everywhere."""
    return f"""WITH RECURSIVE {prefix},
x AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT id FROM {vertices}) AND dst IN (SELECT id FROM {vertices})),
o AS MATERIALIZED (SELECT src, count(*) AS deg FROM x GROUP BY src),
n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM {vertices}),
w AS MATERIALIZED (SELECT id, id NOT IN (SELECT src FROM o) AS dead FROM {vertices}),
r(step, id, dead, rank, diff) AS (
  SELECT 1, id, dead, 1 / (SELECT n FROM n), 1.0::DOUBLE FROM w
  UNION ALL
  SELECT step + 1, id, dead, new, sum(abs(new - rank)) OVER () FROM (
    SELECT r.step, r.id, r.dead, r.rank,
           0.15::DOUBLE / (SELECT n FROM n) + 0.85::DOUBLE * (sum(CASE WHEN r.dead THEN r.rank ELSE 0 END) OVER () / (SELECT n FROM n)) + 0.85::DOUBLE * coalesce(c.s, 0) AS new
    FROM r LEFT JOIN (SELECT x.dst, sum(r.rank / o.deg) AS s FROM x JOIN o USING (src) JOIN r ON r.id = x.src GROUP BY x.dst) c ON c.dst = r.id
    WHERE r.diff >= 0.001)),
last AS (SELECT id, rank FROM r WHERE step = (SELECT max(step) FROM r))
{rest or f'SELECT {columns} FROM last'}"""


#: Fixed values, as in functions/text.py and functions/html.py: what ends a sentence, white space, silent elements.
_WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SILENT = ("frame", "frameset", "iframe", "noembed", "noframes", "noscript", "nostyle", "object", "script", "style")

#: One row a character; then the sentences, as the characters up to each break.
SENTENCES = rf"""{DOCS},
ch AS (SELECT link_id, unnest(string_split(content, '')) AS c, generate_subscripts(string_split(content, ''), 1) AS i FROM d WHERE content <> ''),
nb AS (SELECT link_id, i, c, lag(c) OVER w AS a, lead(c) OVER w AS z, lead(c, 2) OVER w AS more FROM ch WINDOW w AS (PARTITION BY link_id ORDER BY i)),
br AS (SELECT link_id, i, c, a IS NOT NULL AND more IS NOT NULL AND c IN ('.', '!', '?')
       AND (regexp_matches(a, '^\p{{S}}$') OR regexp_matches(a, '^[\p{{Ll}}\p{{N}}{_WHITE}]$') AND regexp_matches(z, '^[\p{{P}}\p{{N}}\p{{Lu}}{_WHITE}]$')) AS ends FROM nb),
no AS (SELECT link_id, i, c, coalesce(sum(ends::INTEGER) OVER (PARTITION BY link_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS ordinal FROM br),
st AS (SELECT link_id, ordinal, string_agg(c, '' ORDER BY i) AS text FROM no GROUP BY 1, 2),
sh AS (SELECT *, (len(list_filter(ws, lambda x: lower(x) IN ('stupid', 'idiot', 'pathetic')))::FLOAT / greatest(len(ws), 1)::FLOAT)::FLOAT AS share
       FROM (SELECT *, list_filter(regexp_split_to_array(text, '[{_WHITE}]+'), lambda x: x <> '') AS ws FROM st))"""

SUMMARY = rf"""WITH RECURSIVE {SENTENCES.replace("WHERE content <> ''", f"WHERE content <> '' AND {HIT}")},
h AS (SELECT link_id FROM d WHERE {HIT}),
k AS MATERIALIZED (SELECT link_id, ordinal, text, row_number() OVER (PARTITION BY link_id ORDER BY share DESC, ordinal) AS k FROM sh JOIN h USING (link_id) WHERE share > 0),
g(link_id, k, ordinal, cut, room) AS (
  SELECT link_id, 0::BIGINT, -1, '', 256::BIGINT FROM h
  UNION ALL
  SELECT link_id, k, ordinal, cut, room - strlen(cut) FROM (
    SELECT g.link_id, k.k, k.ordinal, CASE WHEN strlen(k.text) > g.room THEN substr(k.text, 1, g.room) || '...' ELSE k.text END AS cut, g.room
    FROM g JOIN k ON k.link_id = g.link_id AND k.k = g.k + 1 WHERE g.room > 0)),
j AS (SELECT link_id, ordinal, cut, lag(ordinal) OVER (PARTITION BY link_id ORDER BY ordinal) AS last FROM g WHERE k > 0),
t AS (SELECT link_id, string_agg(CASE WHEN last IS NOT NULL AND ordinal - last <> 1 THEN '..' ELSE '' END || cut || CASE WHEN ends_with(cut, '.') THEN '' ELSE '.' END, '' ORDER BY ordinal) AS s FROM j GROUP BY 1)
SELECT link_id, coalesce(regexp_replace(s, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g'), '') AS summary FROM h LEFT JOIN t USING (link_id)"""


def _stripped(column: str) -> str:
    """Without comments, silent elements and tags; white space collapsed, the entities of the tables decoded, trimmed."""
    text = f"regexp_replace({column}, '(?s)<!--.*?-->', '', 'g')"
    for name in _SILENT:
        text = rf"regexp_replace({text}, '(?is)<{name}\b[^>]*>.*?</{name}[\t\n\f\r ]*>', '', 'g')"
    text = rf"""regexp_replace({text}, '(?s)</?[A-Za-z!?](?:"[^"]*"|''[^'']*''|[^''">])*>', '', 'g')"""
    text = rf"regexp_replace({text}, '[\t\n\f\r ]+', ' ', 'g')"
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{plain}')"
    return rf"regexp_replace({text}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


_TITLE = "regexp_extract(html, '(?i)<title.*?>(.*?)</title>', 1)"

ORACLES: dict[str, str] = {
    "pagerank_converged": _converged(PARTS, "v"),
    "flagship": _converged(
        GRAPH, "g", rest=rf"""SELECT g.url, coalesce(t.title, g.url) AS title, round(last.rank, 9) AS rank FROM last JOIN g USING (id)
        LEFT JOIN (SELECT {_uuid('url')} AS id, {_stripped(_TITLE)} AS title FROM pages) t USING (id) ORDER BY round(last.rank, 9) DESC, g.url LIMIT 10""",
    ),
    "extract_text": f"SELECT page_id, {_stripped(_TITLE)} AS title, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM (SELECT *, {_stripped('html')} AS t FROM pages)",
    "sentence_split": f"WITH {SENTENCES} SELECT link_id, coalesce(n, 0)::INTEGER AS n, md5(coalesce(joined, '')) AS joined_md5 FROM d LEFT JOIN (SELECT link_id, count(*) AS n, string_agg(text, chr(10) ORDER BY ordinal) AS joined FROM st GROUP BY 1) USING (link_id)",
    "match_share": f"WITH {SENTENCES} SELECT link_id, round(coalesce(best, 0)::DOUBLE, 5) AS share FROM d LEFT JOIN (SELECT link_id, max(share) AS best FROM sh GROUP BY 1) USING (link_id)",
    "match_summary": SUMMARY,
    "links_range_scan": f"WITH {LINKS} SELECT * FROM l WHERE id >= '40000000-0000-0000-0000-000000000000' AND id < '80000000-0000-0000-0000-000000000000' AND retrieved_at < TIMESTAMP '2024-01-10'",
    "edges_range_scan": f"WITH {PAGES}, {EDGES} SELECT id, src, dst, updated_at FROM e WHERE src >= '80000000-0000-0000-0000-000000000000' AND src < 'c0000000-0000-0000-0000-000000000000' AND updated_at < TIMESTAMP '2024-01-10'",
    "find_link": f"WITH {LINKS} SELECT * FROM l WHERE url = (SELECT min(url) FROM pages)",
    "find_document": f"WITH {DOCS} SELECT * FROM d WHERE link_id = (SELECT {_uuid('max(doc_id)::VARCHAR')} FROM documents)",
    "upsert_links": f"WITH {GRAPH} SELECT g.id, g.url, greatest(g.retrieved_at, coalesce({_stamp('(p.page_id * 7) % 500')}, g.retrieved_at)) AS retrieved_at FROM g LEFT JOIN pages p ON p.url = g.url",
    "upsert_edges": f"WITH {GRAPH}, w AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT {_uuid('src || dst')} AS id, src, dst, {NOW} AS updated_at FROM w",
    "upsert_edges_unknown": f"WITH {PAGES}, {LINKS}, {EDGES} SELECT src, dst FROM e WHERE dst NOT IN (SELECT id FROM l) OR src NOT IN (SELECT id FROM l)",
    "remove_stale_edges": f"WITH {GRAPH} SELECT id, src, dst, updated_at FROM e WHERE updated_at >= {_stamp('240')}",
    "cascade_delete": f"WITH {GRAPH}, k AS (SELECT id FROM g WHERE url NOT LIKE 'https://%') SELECT id, src, dst, updated_at FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "submit_links": rf"""WITH {GRAPH}, w AS (SELECT url, retrieved_at FROM g UNION ALL SELECT regexp_replace(url, '#.*', ''), TIMESTAMP '0001-01-01' FROM pages WHERE page_id % 4 <> 1)
        SELECT {_uuid('url')} AS id, url, max(retrieved_at) AS retrieved_at FROM w GROUP BY url""",
    "partition_assignment": f"WITH {GRAPH} SELECT 10::INTEGER AS parts, {_part(10)} AS part, count(*) AS n FROM g GROUP BY part UNION ALL SELECT 11, {_part(11)} AS part, count(*) FROM g GROUP BY part",
    "id_roundtrip": f"WITH {LINKS} SELECT id, upper(replace(id, '-', '')) AS raw, id AS back FROM l",
    "extract_links": f"WITH {PAGES}, w AS (SELECT page_id, string_agg(link, ' ' ORDER BY ordinal) AS links, count(*)::INTEGER AS n FROM a GROUP BY 1) SELECT pages.page_id, coalesce(links, '') AS links, '' AS nofollow_links, coalesce(n, 0)::INTEGER AS n FROM pages LEFT JOIN w USING (page_id)",
    "extract_links_exploded": f"WITH {PAGES} SELECT url, ordinal::INTEGER AS ordinal, link, false AS nofollow FROM a",
    "url_exclusion": f"WITH {PAGES} SELECT url, link, length(link) % 6 IN (0, 2, 4) AS excluded FROM a",
    "link_cases": """WITH w AS (SELECT *, doc_id % 3 = 0 AS b FROM documents)
        SELECT doc_id, 'No ' || doc_id || ' & more' AS title,
        CASE WHEN b THEN 'http://b' || doc_id % 7 || '.example.net/dir/' ELSE 'http://site' || doc_id % 11 || '.example.com/a/' END || 'p' || doc_id || '.html '
        || CASE WHEN b THEN 'http://b' || doc_id % 7 || '.example.net/' ELSE 'http://site' || doc_id % 11 || '.example.com/' END || 'up?x=' || doc_id AS links,
        'http://h' || doc_id % 5 || '.example.org/x' AS nofollow_links FROM w""",
    "external_documents": f"WITH {DOCS} SELECT link_id AS LinkID, url AS URL, strftime(indexed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS IndexedAt, length(content)::INTEGER AS n_chars, pagerank AS PageRank FROM d",
    "bsp_send_to": f"""WITH {PARTS}, m AS (SELECT 's' || (substr(id, 2)::BIGINT % 7 + 1) AS id, substr(id, 2)::BIGINT AS x FROM v WHERE id LIKE 'p%')
        SELECT id, md5(string_agg(x::VARCHAR, ',' ORDER BY x)) AS list_md5 FROM m WHERE id IN (SELECT id FROM v) GROUP BY id""",
    "retain_links": rf"WITH {PAGES} SELECT url, count(*) AS kept, max(regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM a GROUP BY url",
    "extract_title": r"SELECT page_id, regexp_extract(html, '(?i)<title.*?>(.*?)</title>', 1) AS title FROM pages",
    "private_network_filter": """WITH w AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS x FROM events)
        SELECT event_id, concat_ws('.', x >> 24, (x >> 16) % 256, (x >> 8) % 256, x % 256) AS ip,
        (x >> 24) IN (127, 10, 0) OR (x >> 20) = 172 * 16 + 1 OR (x >> 16) IN (192 * 256 + 168, 169 * 256 + 254) OR x = 4294967295 AS private FROM w""",
    "fetch_filter": rf"WITH {LINKS} SELECT l.id AS link_id, l.url, l.retrieved_at, length(html)::INTEGER AS n_chars FROM l JOIN pages USING (url) WHERE page_id % 5 = 0 AND NOT regexp_matches(l.url, '(?i)\.(?:jpg|jpeg|png|gif|ico|css|js)$')",
    "crawl_graph_update": f"WITH {PAGES}, {EDGES} SELECT id, src, dst, {NOW} AS updated_at FROM e",
    "crawl_links_update": f"WITH {GRAPH} SELECT id, url, CASE WHEN url IN (SELECT url FROM pages) THEN {NOW} ELSE retrieved_at END AS retrieved_at FROM g",
    "out_degree": f"WITH {PARTS} SELECT src, count(*) AS degree FROM e WHERE src <> dst GROUP BY src",
    "in_contrib": f"WITH {PARTS}, o AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT dst AS id, round(sum(1.0::DOUBLE / n), 9) AS received FROM e JOIN o USING (src) GROUP BY dst",
    "dead_end_links": f"WITH {GRAPH} SELECT id FROM g WHERE id NOT IN (SELECT src FROM e WHERE src <> dst)",
    "aggregators": f"WITH {PARTS} SELECT sum(length(id) + 1)::DOUBLE AS total, count(*)::DOUBLE AS change, count(*) AS n, count(*) AS active FROM v",
    "bsp_broadcast": f"WITH {PARTS}, w AS (SELECT id, ('0x' || substr(md5(id), 1, 12))::BIGINT::DOUBLE AS x FROM v) SELECT v.id, coalesce((SELECT max(x) FROM e JOIN w ON w.id = e.src WHERE e.dst = v.id), (SELECT x FROM w WHERE w.id = v.id)) AS value FROM v",
    "bsp_freeze": f"WITH {PARTS} SELECT id, CASE WHEN id LIKE 'p%' THEN (SELECT count(*) FROM e WHERE dst = id) ELSE 0 END::DOUBLE AS value, false AS active FROM v",
    "pagerank_pages_fixed": _ranks(GRAPH, "g", 7),
    "pagerank_parts_fixed": _ranks(PARTS, "v", 7),
    "index_preserves_score": f"""WITH {DOCS}
        SELECT link_id, url, 'again' AS title, md5(content || ' again') AS content_md5, {NOW} AS indexed_at, pagerank FROM d
        UNION ALL SELECT {_uuid('url')}, url, 'page', md5(html), {NOW}, 0.0::DOUBLE FROM pages""",
    "update_scores_placeholder": f"""WITH {DOCS} SELECT link_id, url, length(content)::INTEGER AS n_chars, indexed_at, pagerank / 2 AS pagerank FROM d
        UNION ALL SELECT {_uuid('url')}, '', 0, TIMESTAMP '0001-01-01', 0.25::DOUBLE FROM pages""",
    "postings": f"WITH {DOCS}, t AS (SELECT link_id, unnest({TOKENS}) AS term FROM d) SELECT term, count(DISTINCT link_id) AS df, count(*) AS cf FROM t GROUP BY term",
    "search_match": f"WITH {DOCS} SELECT link_id, pagerank FROM d WHERE {HIT}",
    "search_phrase": f"WITH {DOCS} SELECT link_id, pagerank FROM d WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ')",
    "search_offset": f"WITH {_bm25()} SELECT link_id, pagerank FROM q ORDER BY pagerank DESC, score DESC, link_id LIMIT 10 OFFSET 5",
    "search_total": f"WITH {DOCS} SELECT count(*) FILTER ({HIT}) AS n_match, count(*) FILTER (contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ')) AS n_phrase FROM d",
    "search_bm25": f"WITH {_bm25()} SELECT link_id, round(score, 6) AS score FROM q",
    "search_additive": f"WITH {_bm25()} SELECT link_id, round(score * (score + pagerank), 6) AS score FROM q",
    "highlight": f"WITH {DOCS} SELECT link_id, md5(regexp_replace(regexp_replace(regexp_replace(content, '(?i)(stupid)', '<em>\\1</em>', 'g'), '(?i)(idiot)', '<em>\\1</em>', 'g'), '(?i)(pathetic)', '<em>\\1</em>', 'g')) AS marked_md5 FROM d",
    "html_escape": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;')) AS escaped_md5 FROM pages""",
    "pagination": f"""WITH {DOCS}, n AS (SELECT count(*) AS n FROM d WHERE {HIT}), o AS (SELECT unnest(generate_series(0, greatest(0, n - 1), 10)) AS o, n FROM n)
        SELECT CASE WHEN n > 0 THEN o + 1 ELSE 0 END AS first, o + least(10, n - o) AS last, n AS total,
        CASE WHEN o > 10 THEN '/search?q=q&offset=' || (o - 10) WHEN o > 0 THEN '/search?q=q' ELSE '' END AS prev, CASE WHEN o + 10 < n THEN '/search?q=q&offset=' || (o + 10) ELSE '' END AS next FROM o""",
    "title_fallback": f"WITH {DOCS} SELECT link_id, url AS title FROM d",
    "pipeline_filter": f"WITH {DOCS} SELECT link_id, length(content)::INTEGER AS n_chars FROM d WHERE contains(content, '.')",
    "broadcast_stage": f"WITH {DOCS} SELECT 'chars' AS kind, link_id, length(content) AS n FROM d UNION ALL SELECT 'tokens', link_id, len({TOKENS}) FROM d",
    "window_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
