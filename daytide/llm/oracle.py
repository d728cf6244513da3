"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
placed AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13
),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM placed),
later AS (
  SELECT doc_id, i FROM windows
  QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id
),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM later),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d) w
  ANTI JOIN gone USING (doc_id, i)
  GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op2_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
),
item AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[i:i + 12], ' ') AS g
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT n FROM item),
hit AS (
  SELECT p.doc_id, p.i, p.n, item.item_id
  FROM (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)) p
  JOIN item ON item.n = p.n AND item.g = p.g
),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, i + unnest(range(n)) AS pos FROM hit) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op7_warc"] = r"""
WITH p AS (
  SELECT page_id, regexp_replace(url, '[\x00-\x1F\x7F]', '%20', 'g') AS uri, coalesce(html, '') AS body,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
),
r AS (
  SELECT *, strlen(body) AS size, sha256(body) AS digest, strlen(body) >= 100 AND page_id <> first AS again FROM p
),
w AS (
  SELECT *, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END,
    'WARC-Record-ID: <urn:page:' || page_id || ':' || digest || '>', 'WARC-Target-URI: ' || uri,
    'WARC-Date: 2024-01-01T00:00:00Z', 'WARC-Payload-Digest: sha256:' || digest,
    CASE WHEN again THEN 'WARC-Refers-To: <urn:page:' || first || ':' || digest || '>' END,
    CASE WHEN again THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END,
    'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || CASE WHEN again THEN 0 ELSE size END)
    || repeat(chr(13) || chr(10), 2) || CASE WHEN again THEN '' ELSE body END || repeat(chr(13) || chr(10), 2) AS record
  FROM r
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
  CAST(strlen(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256
FROM w
"""

SQL["op8_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM d WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * k >= 80 * (s.n + t.n - k)
),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce(y, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(y, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)
"""

_INSIDE = "A-Za-z0-9+/_=-"
# kind, rank, pattern, group, and what a match must fulfil
_BASE = [
    (
        "assign",
        0,
        r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        "length(body) >= 6",
    ),
    ("access", 1, "AKIA[A-Z0-9]+", 0, "length(body) >= 20"),
    ("hex", 2, "[0-9a-f]+", 0, "length(body) >= 24"),
    ("run", 9, f"[{_INSIDE}]+", 0, "length(body) >= 20"),
]


def _matches(kind: str, rank: int, pattern: str, group: int, ok: str) -> str:
    """Matches with their places: running lengths of the gaps and the matches before."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, body, CAST(stop - length(found) AS BIGINT) AS start,
    CAST(stop AS BIGINT) AS stop
  FROM (
    SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
    FROM (
      SELECT doc_id, unnest(found) AS found, unnest(body) AS body, unnest(gap[:len(found)]) AS gap,
        generate_subscripts(found, 1) AS i
      FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found,
          regexp_extract_all(text, '{pattern}', {group}) AS body, string_split_regex(text, '{pattern}') AS gap
        FROM d
      )
    )
  ) WHERE {ok}"""


SQL["op9_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_matches(*k) for k in _BASE[:3])}),
runs AS (
  SELECT *, string_split(body, '') AS chars, regexp_full_match(body, '[0-9A-Fa-f]+') AS hexed
  FROM ({_matches(*_BASE[3])})
  WHERE NOT regexp_matches(body, '(?i)example|sample|dummy|placeholder|x{{6}}|0123456789|abcdefgh')
),
varied AS (
  SELECT * FROM runs
  WHERE NOT list_contains(list_transform(range(1, len(chars) - 6), lambda i: list_unique(chars[i:i + 7])), 1)
),
candidate AS (
  SELECT doc_id, 'entropy_hex' AS kind, 3 AS rank, start, 2.9 AS bits, string_split(lower(body), '') AS chars
  FROM varied WHERE hexed AND regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Fa-f]')
  UNION ALL
  SELECT doc_id, 'entropy_base64', 4, start, 3.7, chars
  FROM varied WHERE regexp_matches(body, '[0-9]') AND regexp_matches(body, '[a-z]') AND regexp_matches(body, '[A-Z]')
),
dense AS (
  SELECT doc_id, kind, rank, start, list_filter(range(1, len(chars) - 18),
    lambda i: list_aggregate(chars[i:i + 19], 'entropy') >= bits - 1e-9) AS places
  FROM candidate
),
added AS (
  SELECT doc_id, kind, rank, start + list_min(places) - 1 AS start, start + list_max(places) + 19 AS stop
  FROM dense WHERE len(places) > 0
),
spans AS (
  SELECT doc_id, kind, rank, start, stop FROM base
  UNION ALL
  SELECT * FROM added a
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a.stop <= b.stop)
),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""

SQL["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
f AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d
),
l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic
  FROM labels GROUP BY doc_id
),
g AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (l.good) AS good, count(*) FILTER (l.toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
),
letters(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31
),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INTEGER AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)
),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (earlier | bit) = 0) AS kept,
    sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0) AS good_lost,
    sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0) AS toxic_lost
  FROM g, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM counted
"""
