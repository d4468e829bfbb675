"""DuckDB SQL for the corpus queries that SQL can express; the others are held against brute force
in tests/llm."""

op5_url_filter = r"""
WITH pages_of AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(trim(url), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:@]*)', 1)), '\\.$', ''), '') AS host
  FROM pages),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM pages_of WHERE host IS NOT NULL),
names AS (
  SELECT host, k AS depth, array_to_string(p[k:len(p)], '.') AS domain
  FROM (SELECT host, p, unnest(range(1, CASE WHEN regexp_matches(host, '^\[|^[0-9]+([.][0-9]+){3}$') THEN 2 ELSE greatest(2, len(p)) END)) AS k FROM parts)),
listed AS (SELECT DISTINCT domain, DATE '2024-01-01' + CAST(7 * length(domain) % 100 AS INTEGER) AS day FROM names WHERE length(domain) % 3 = 0),
active AS (
  SELECT domain, day AS since, day + 60 AS until FROM listed
  UNION ALL SELECT domain, day + 210, NULL FROM listed),
hits AS (
  SELECT p.page_id, a.domain, a.since, row_number() OVER (PARTITION BY p.page_id ORDER BY n.depth) AS rank
  FROM pages_of p JOIN names n ON n.host = p.host JOIN active a ON a.domain = n.domain
  WHERE a.since <= p.fetched AND (a.until IS NULL OR p.fetched < a.until))
SELECT p.page_id, p.host, p.fetched, h.domain IS NOT NULL AS blocked, h.domain, h.since
FROM pages_of p LEFT JOIN hits h ON h.page_id = p.page_id AND h.rank = 1
"""

# one row for each document; the steps of crc32 over a byte come from its polynomial
op13_importance = r"""
WITH crc_steps AS (
  SELECT list(list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps
  FROM (SELECT range::BIGINT AS b FROM range(256))),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word, true AS own FROM documents
  UNION ALL
  SELECT NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')), false FROM benchmark),
features AS (SELECT word, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM words GROUP BY word),
hashed AS (
  SELECT word, s, t, xor(list_reduce(list_transform(range(0, length(hex(encode(word))), 2), lambda i: ('0x' || substr(hex(encode(word)), i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM features, crc_steps),
cells AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM cells),
scored AS (
  SELECT d.doc_id, coalesce(w.n, 0)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
    coalesce(w.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE own GROUP BY doc_id) w ON w.doc_id = d.doc_id),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM placed
"""

# a fold over the rows with the cheapest way to each ending; conversations have one row a turn
op11_conversation_repair = r"""
WITH RECURSIVE crc_steps AS (
  SELECT list(list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps
  FROM (SELECT range::BIGINT AS b FROM range(256))),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (
  SELECT n.*, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM named n, crc_steps),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) c WHERE kind <> 0 AND (c.range = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    CASE WHEN i > 1 THEN lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) END AS pair FROM placed),
told AS (
  SELECT conv_id, i, turn, role, text, pair, final = '' AS blank, final <> '' AND nth > 1 AS duplicate, final <> '' AND nth = 1 AND final NOT IN ('.', '!', '?') AS truncated FROM seen),
-- the cheapest way to each ending (nothing, system, user, assistant) after row i: cost, edits, repaired lines
walk AS (
  SELECT conv_id, 0 AS i, {'c': 0, 'a': '', 't': ''} AS n, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i,
    {'c': n.c + 4, 'a': n.a || 'D', 't': n.t},
    list_min(list_filter([CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 'a': s.a || 'D', 't': s.t} END, CASE WHEN keep AND left(role, 1) = 's' THEN {'c': n.c + charge, 'a': n.a || 'K', 't': n.t || line} END], lambda x: x IS NOT NULL)),
    list_min(list_filter(list_concat([{'c': wu.c + 4, 'a': wu.a || 'D', 't': wu.t}],
      list_transform([n, s, wa], lambda x: CASE WHEN x IS NOT NULL AND keep AND left(role, 1) = 'u' THEN {'c': x.c + charge, 'a': x.a || 'K', 't': x.t || line} END),
      list_transform([n, s, wa], lambda x: CASE WHEN x IS NOT NULL AND keep THEN {'c': x.c + charge + 3, 'a': x.a || 'R', 't': x.t || chr(10) || 'user:' || text} END)), lambda x: x IS NOT NULL)),
    list_min(list_filter([{'c': wa.c + 4, 'a': wa.a || 'D', 't': wa.t},
      CASE WHEN keep AND left(role, 1) = 'a' THEN {'c': wu.c + charge, 'a': wu.a || 'K', 't': wu.t || line} END,
      CASE WHEN keep THEN {'c': wu.c + charge + 3, 'a': wu.a || 'R', 't': wu.t || chr(10) || 'assistant:' || text} END], lambda x: x IS NOT NULL))
  FROM (
    -- empty turns put in before the row
    SELECT w.conv_id, r.i, w.n, w.s, role, text, chr(10) || role || ':' || text AS line, NOT (blank OR duplicate) AS keep, CASE WHEN truncated THEN 3 ELSE 0 END AS charge,
      list_min(list_filter(list_concat([w.u], list_transform([w.n, w.s, w.a], lambda x: CASE WHEN x IS NOT NULL THEN {'c': x.c + 3, 'a': x.a || 'I', 't': x.t || chr(10) || 'user:'} END)), lambda x: x IS NOT NULL)) AS wu,
      list_min(list_filter(list_concat([w.a], list_transform([w.u], lambda x: CASE WHEN x IS NOT NULL THEN {'c': x.c + 3, 'a': x.a || 'I', 't': x.t || chr(10) || 'assistant:'} END),
        list_transform([w.n, w.s], lambda x: CASE WHEN x IS NOT NULL THEN {'c': x.c + 6, 'a': x.a || 'II', 't': x.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END)), lambda x: x IS NOT NULL)) AS wa
    FROM walk w JOIN told r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
ends AS (
  SELECT w.conv_id, list_min(list_filter([w.n, w.a, CASE WHEN w.u IS NOT NULL THEN {'c': w.u.c + 3, 'a': w.u.a || 'I', 't': w.u.t || chr(10) || 'assistant:'} END,
    CASE WHEN w.s IS NOT NULL THEN {'c': w.s.c + 6, 'a': w.s.a || 'II', 't': w.s.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END], lambda x: x IS NOT NULL)) AS best
  FROM walk w JOIN (SELECT conv_id, max(i) AS i FROM walk GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
