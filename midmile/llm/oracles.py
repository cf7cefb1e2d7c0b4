"""Oracle texts in plain SQL, written from the definitions: all pairs and all windows, no index."""

from __future__ import annotations

from midmile.llm.chat import END, SEP, START

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(column)}, '{pattern}')"


OP3 = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS newest FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM m"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text', _ITEM_WORD)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text', _ITEM_WORD)} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT size FROM win),
spots AS (SELECT r, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS s
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d JOIN sizes ON len(w) >= size) x),
hit AS (SELECT r, k, spots.size AS size, item FROM spots JOIN win ON spots.s = win.s AND spots.size = win.size),
places AS (SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT r, k, size FROM hit) y) x GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hit) x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""

_SPACED_WORD = r"[^\x20\x09-\x0D]+"
OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _SPACED_WORD)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id ON a = d.doc_id"""


def _escaped_size(column: str) -> str:
    """Code points of the escaped text: a code is one longer than the sign it stands for."""
    found = [r"\\", r"<\|", r"</?s>", r"<</?SYS>>", r"\[/?INST\]"]
    return f"length({column}) + " + " + ".join(f"len(regexp_extract_all({column}, '{p}'))" for p in found)


OP6 = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
  CAST(sum({len(START) + len(SEP) + len(END)} + {_escaped_size('role')} + {_escaped_size('text')}) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y
  ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN least_id ON least_id.a = vec_id"""

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
OP10 = rf"""
WITH p AS (SELECT page_id, url, page_id * 7919 % 31536000 AS fetched,
  lower(regexp_extract(url, '{_SCHEME}(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
  regexp_extract(url, '{_SCHEME}[^/?#]*([^#]*)', 1) AS rest FROM pages),
q AS (SELECT *, CASE WHEN rest LIKE '/%' THEN rest ELSE concat('/', rest) END AS path, string_split(host, '.') AS parts FROM p WHERE host <> ''),
k AS (
  SELECT page_id, concat('url:', host, path) AS key FROM q
  UNION SELECT page_id, concat('prefix:', host, regexp_extract(path, '^(/[^/?]+/)', 1)) FROM q WHERE regexp_matches(path, '^/[^/?]+/')
  UNION SELECT page_id, concat('host:', host) FROM q
  UNION SELECT page_id, concat('domain:', array_to_string(list_slice(parts, i, len(parts)), '.'))
    FROM (SELECT page_id, parts, unnest(range(2, len(parts))) AS i FROM q WHERE len(parts) > 2) x),
sorted AS (SELECT page_id, list(key ORDER BY key) AS all_keys FROM k GROUP BY page_id),
records AS (SELECT ['adult', 'malware', 'spam'][page_id % 3 + 1] AS list, all_keys[page_id % len(all_keys) + 1] AS key,
  page_id * 104729 % 31536000 AS since, min(page_id % 7 < 4) AS active FROM sorted GROUP BY ALL),
held AS (SELECT *, lead(since) OVER (PARTITION BY list, key ORDER BY since) AS until FROM records),
found AS (SELECT p.page_id AS page_id, count(*) AS n_entries, min(list_position(['url', 'prefix', 'host', 'domain'], split_part(k.key, ':', 1))) AS kind,
  string_agg(DISTINCT held.list, ',' ORDER BY held.list) AS lists
  FROM p JOIN k ON k.page_id = p.page_id JOIN held ON held.key = k.key
  WHERE held.active AND fetched >= since AND (until IS NULL OR fetched < until) GROUP BY p.page_id)
SELECT p.page_id AS page_id, fetched, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists,
  ['url', 'prefix', 'host', 'domain'][kind] AS kind, coalesce(n_entries, 0) AS n_entries
FROM p LEFT JOIN found ON found.page_id = p.page_id"""

ORACLES = {
    "op3_warc": OP3,
    "op4_decontaminate": OP4,
    "op5_near_duplicates": OP5,
    "op6_chat": OP6,
    "op9_vector_join": OP9,
    "op10_url_lists": OP10,
}
