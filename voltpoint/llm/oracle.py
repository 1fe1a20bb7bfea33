"""SQL counterparts of the registered corpus queries."""

from __future__ import annotations

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, p, p + least(10, len(w)) - 1) AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
places AS (
  SELECT r, p, size, list_slice(w, p, p + size - 1) AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM d CROSS JOIN (SELECT DISTINCT size FROM windows))),
found AS (SELECT r, p, p + places.size - 1 AS q, item_id FROM places JOIN windows USING (size, words)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, q + 1)) AS k FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(md5(text), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS i
  FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0e0 WHEN 1 THEN 1.0e0 ELSE 2.0e0 END AS w,
             CASE i % 3 WHEN 0 THEN -0.5e0 WHEN 1 THEN 0.0e0 ELSE 0.5e0 END AS slope, source_size * 2 AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - CAST(coalesce(sum(cap) OVER r, 0) AS DOUBLE))
                / (sum(w) OVER () - coalesce(sum(w) OVER r, 0.0e0)) AS level
      FROM w WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, slope, least(CAST(cap AS DOUBLE), w * max(level) OVER ()) AS target FROM l),
p AS (SELECT doc_id, size, source_size, slope, target,
             CAST(2 * coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS BIGINT) AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN middle + source_size * 2 <= target * 2 THEN 2 WHEN middle <= target * 2 THEN 1 ELSE 0 END AS copies,
             least(1.0e0, CAST(middle AS DOUBLE) / (target * 2)) AS due FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN 2 * due / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * due)) END AS first_position
FROM c
"""

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(md5(text), '')), 1, 11))::BIGINT AS h
  FROM documents),
n AS (
  SELECT r, depth, h >> (44 - depth) AS prefix,
         sum(n_bytes) OVER b AS bytes, count(*) OVER b AS n
  FROM (SELECT r, h, n_bytes, CAST(unnest(range(0, 45)) AS INTEGER) AS depth FROM d)
  WINDOW b AS (PARTITION BY depth, h >> (44 - depth))),
s AS (SELECT r, min(depth) AS depth, arg_min(prefix, depth) AS prefix, arg_min(bytes, depth) AS bytes
      FROM n WHERE bytes <= 1048576 OR n = 1 OR depth = 44 GROUP BY r)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       CAST(bytes AS BIGINT) AS shard_bytes, bytes > 1048576 AS oversized
FROM d JOIN s USING (r)
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + least(5, len(w)) - 1) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT r, doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT r, p, md5(b[p:p + 399]) AS k FROM (SELECT r, b, unnest(range(1, n - 398)) AS p FROM n WHERE n >= 400)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p FROM w JOIN twice USING (k)),
edge AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, true) AS new FROM hit),
run AS (SELECT r, min(p) AS a, max(p) + 400 AS z
        FROM (SELECT r, p, count(*) FILTER (WHERE new) OVER (PARTITION BY r ORDER BY p) AS g FROM edge) GROUP BY r, g),
gap AS (SELECT r, coalesce(lag(z) OVER o, 1) AS a, a - 1 AS z FROM run WINDOW o AS (PARTITION BY r ORDER BY a)
        UNION ALL SELECT r, max(z), any_value(n.n) FROM run JOIN n USING (r) GROUP BY r
        UNION ALL SELECT r, 1, n FROM n WHERE r NOT IN (SELECT r FROM run)),
kept AS (SELECT r, string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a) AS h FROM gap JOIN n USING (r) GROUP BY r),
gone AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM n LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
kinds(kind, rank, pattern, grp, least) AS (VALUES
  ('assign', 1, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 12),
  ('access', 2, '(AKIA[A-Z0-9]+)', 1, 18),
  ('hex', 3, '([0-9a-f]{16,})', 1, 16),
  ('live', 4, '([A-Za-z0-9+/_-]{20,})', 1, 20)),
m AS (
  SELECT r, kind, rank, least, regexp_extract_all(t, pattern) AS found, regexp_extract_all(t, pattern, 1) AS vals,
         string_split_regex(t, pattern) AS gaps
  FROM d CROSS JOIN kinds WHERE regexp_matches(t, pattern)),
u AS (SELECT r, kind, rank, least, unnest(range(1, len(found) + 1)) AS i, found, vals, gaps FROM m),
s AS (SELECT r, kind, rank, least, vals[i] AS v, length(found[i]) AS n,
             sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM u),
c AS (SELECT s.*, stop - n AS start, source FROM s JOIN d USING (r) WHERE length(v) >= least),
o AS (SELECT v, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners FROM c GROUP BY v),
j AS (SELECT r, kind, rank, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span, owners,
             regexp_matches(v, '[0-9]') AND (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
               OR length(v) >= 32 AND regexp_matches(v, '[A-Za-z]')) AS random
      FROM c JOIN o USING (v)),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'live') AS base,
             string_agg(span, ',' ORDER BY start, rank) AS spans,
             count(*) FILTER (WHERE kind <> 'live' AND owners = 1) AS n_live,
             count(*) FILTER (WHERE kind <> 'live' AND owners > 1) AS n_copied
      FROM j WHERE kind <> 'live' OR random AND owners = 1 GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN g USING (r)
"""

OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, prefix, text, sha256(prefix || body) AS leaf,
         -- The lowest bit of the CRC-32 of the id's digits.
         coalesce(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
           4294967295) & 1 = 1, false) AS hit
  FROM (SELECT *, coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
          coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
          || coalesce(octet_length(encode(source)) || ':' || source, '-')
          || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
          || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS prefix FROM documents)),
leaves AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n,
         CASE WHEN hit AND text IS NOT NULL
              THEN sha256(prefix || octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''))
              ELSE leaf END AS given
  FROM d),
tree AS (
  SELECT source, 0 AS k, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, k + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i))
  FROM tree WHERE n > 1 GROUP BY source, k, i // 3),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS k, i, n, h FROM subroots
  UNION ALL
  SELECT k + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 3),
fold AS (
  SELECT r, source, 0 AS k, i, n, given AS h, '' AS path FROM leaves
  UNION ALL
  SELECT f.r, any_value(f.source), f.k + 1, f.i // 3, any_value((t.n + 2) // 3),
         sha256(string_agg(CASE WHEN t.i = f.i THEN f.h ELSE t.h END, '' ORDER BY t.i)),
         any_value(f.path) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i <> f.i), '')
  FROM fold f JOIN tree t ON t.source IS NOT DISTINCT FROM f.source AND t.k = f.k AND t.i // 3 = f.i // 3
  WHERE f.n > 1 GROUP BY f.r, f.k, f.i),
top_fold AS (
  SELECT r, s.source, s.h AS subroot, 0 AS k, s.i, s.n, f.h, f.path
  FROM fold f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
  UNION ALL
  SELECT f.r, any_value(f.source), any_value(f.subroot), f.k + 1, f.i // 3, any_value((t.n + 2) // 3),
         sha256(string_agg(CASE WHEN t.i = f.i THEN f.h ELSE t.h END, '' ORDER BY t.i)),
         any_value(f.path) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i <> f.i), '')
  FROM top_fold f JOIN top t ON t.k = f.k AND t.i // 3 = f.i // 3
  WHERE f.n > 1 GROUP BY f.r, f.k, f.i)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves JOIN (SELECT * FROM top_fold WHERE n = 1) f USING (r) CROSS JOIN (SELECT h AS root FROM top WHERE n = 1)
"""

OP12 = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(low, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM pieces CROSS JOIN (VALUES (1), (2), (3)) AS s(m))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT lang, m, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, m), ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, h.a AS l, r.a AS r,
         (1000000::HUGEINT * c.a * c.a // (h.a::HUGEINT * r.a))::BIGINT AS score
  FROM cut c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, a, array_to_string(list_slice(w, p, p + 1), ' ') AS phrase
  FROM (SELECT lang, a, string_split(phrase, ' ') AS w, unnest([1, 2]) AS p FROM f WHERE m = 3)),
longest AS (SELECT lang, phrase, max(a) AS most FROM inner_pairs GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longest g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.most IS NULL OR 100 * g.most < 50 * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE = {
    "op3_mixing": OP3,
    "op4_sharding": OP4,
    "op7_secrets": OP7,
    "op8_substrings": OP8,
    "op9_benchmark": OP9,
    "op10_near_duplicates": OP10,
    "op11_manifest": OP11,
    "op12_collocations": OP12,
}
