"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

_SECRET_PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
]


def _secret_kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
    SELECT n, {rank} AS rank, '{kind}' AS kind, h.s AS s, h.e AS e FROM (
      SELECT n, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{
        's': CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS BIGINT),
        'e': CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i], lambda g: length(g))), 0) AS BIGINT),
        'n': length(vals[i])}}), lambda x: x.n >= {least})) AS h
      FROM (SELECT n, regexp_extract_all(body, {p}, 0) AS hits, regexp_extract_all(body, {p}, {group}) AS vals, string_split_regex(body, {p}) AS gaps FROM d))"""


_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS body FROM documents),
f AS ({" UNION ALL ".join(_secret_kind(i, *x) for i, x in enumerate(_SECRET_PATTERNS))}),
g AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (n)
"""

_URLS = """
WITH p AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS k FROM pages),
q AS (SELECT page_id, CASE WHEN k > 0 THEN substr(u, k + 3) ELSE '' END AS r FROM p),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(v, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM h
"""

_GROUPS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, {5 * i + 1}, 5) AS BIGINT) >> {s}) & 31 AS BIGINT) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, 'about:blank') AS url, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS x FROM pages),
k AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, {_GROUPS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^([^/?#:]*)', 1)), '.')), ',') || ')' || substr(rest, length(regexp_extract(rest, '^([^/?#:]*)', 1)) + 1) AS url_key
FROM k
"""

_JOIN = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT n, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
size AS (SELECT n, count(*) AS k FROM sh GROUP BY n),
shared AS (SELECT a.n AS a, b.n AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.n < b.n GROUP BY 1, 2),
half AS (SELECT a, b FROM shared JOIN size x ON x.n = a JOIN size y ON y.n = b WHERE 100 * o >= 80 * (x.k + y.k - o)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT n, n AS m FROM d UNION SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.m)
SELECT d.doc_id, coalesce(any_value(size.k), 0) AS n_shingles, min(t.doc_id) AS component_id
FROM d JOIN reach r ON r.n = d.n JOIN d t ON t.n = r.m LEFT JOIN size ON size.n = d.n GROUP BY d.n, d.doc_id
"""

_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT n, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT n, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
low AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT n, i, lag(i) OVER (PARTITION BY n ORDER BY i) AS j FROM w JOIN low USING (s) WHERE doc_id > m),
numbered AS (SELECT n, i, sum(CASE WHEN j IS NULL OR i > j + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM hit),
span AS (SELECT n, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY n, k),
gap AS (SELECT n, k, a, b, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS z FROM span),
kept AS (SELECT n, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS parts, max(b) AS z, sum(b - a) AS removed, count(*) AS spans FROM gap JOIN d USING (n) GROUP BY n)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(parts, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (n)
"""

SQL: dict[str, str] = {"op5_suffix_dedup": _REPEATS, "op8_ngram_join": _JOIN, "op4_secret_scan": _SECRETS, "op6_url_filter": _URLS, "op9_warc": _WARC}
