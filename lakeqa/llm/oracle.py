"""DuckDB SQL for those queries that SQL can express."""

ORACLE = {}

ORACLE["op1_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
h AS (SELECT hex, min(page_id) AS head FROM p GROUP BY hex),
c AS (SELECT hex, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
      ('0x' || substr(hex, (10 * (i // 8) + 1)::INT, 10))::BIGINT
    ) >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS digest FROM h)
SELECT p.page_id, octet_length(encode(p.body))::BIGINT AS payload_bytes, c.digest AS payload_digest,
  CASE WHEN p.page_id = h.head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = h.head THEN NULL ELSE h.head END AS refers_to
FROM p JOIN h USING (hex) JOIN c USING (hex)
"""

ORACLE["op7_url_filter"] = """
WITH u AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
k AS (
  SELECT page_id, path,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM h),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM k JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM k LEFT JOIN m USING (page_id)
"""

ORACLE["op5_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, phrase)),
places AS (SELECT doc_id, count(DISTINCT place)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op3_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*)::BIGINT AS n_links FROM l GROUP BY a)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLE["op2_metric_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# States: 0 nothing yet, 1 a system turn, 2 a user's last, 3 an assistant's last. crc32 is built bit by bit.
ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20
    AS kind FROM t),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
      sha256(octet_length(encode(role))::VARCHAR || ':' || role || text), copy) AS i,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM d),
m AS (
  SELECT *, tail = '' AS blank,
    tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS (SELECT *, tail NOT IN ('', '.', '!', '?') AND NOT duplicate AS truncated FROM m),
ins(st, too, n, added) AS (VALUES (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []),
  (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']),
  (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:'])),
edit(st, c, too, kind, price, role) AS (VALUES
  (0, 's', 1, 'K', 0, NULL), (0, 'u', 2, 'K', 0, NULL), (1, 'u', 2, 'K', 0, NULL), (2, 'a', 3, 'K', 0, NULL),
  (3, 'u', 2, 'K', 0, NULL), (0, NULL, 2, 'R', 2, 'user'), (1, NULL, 2, 'R', 2, 'user'),
  (2, NULL, 3, 'R', 2, 'assistant'), (3, NULL, 2, 'R', 2, 'user'),
  (0, NULL, 0, 'D', 3, NULL), (1, NULL, 1, 'D', 3, NULL), (2, NULL, 2, 'D', 3, NULL), (3, NULL, 3, 'D', 3, NULL)),
p AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS st, 0 AS cost, '' AS audit, []::VARCHAR[] AS kept FROM f
  UNION ALL
  SELECT conv_id, i, st, w.cost, w.audit, w.kept FROM (
    SELECT conv_id, i, st, min({'cost': cost, 'audit': audit, 'kept': kept}) AS w FROM (
      SELECT f.conv_id, f.i, edit.too AS st,
        p.cost + 2 * ins.n + price + CASE WHEN f.truncated AND edit.kind <> 'D' THEN 1 ELSE 0 END AS cost,
        p.audit || repeat('I', ins.n) || edit.kind AS audit,
        list_concat(p.kept, list_concat(ins.added,
          CASE WHEN edit.kind = 'D' THEN [] ELSE [coalesce(edit.role, f.role) || ':' || f.text] END)) AS kept
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
        JOIN ins ON ins.st = p.st JOIN edit ON edit.st = ins.too
      WHERE edit.kind = 'D' OR NOT (f.blank OR f.duplicate) AND (edit.kind = 'R' OR edit.c = f.c))
    GROUP BY conv_id, i, st)),
e AS (
  SELECT conv_id, min({'cost': cost, 'audit': audit, 'kept': kept}) AS w FROM (
    SELECT p.conv_id, p.cost + 2 * ins.n AS cost, p.audit || repeat('I', ins.n) AS audit,
      list_concat(p.kept, ins.added) AS kept
    FROM p JOIN ins ON ins.st = p.st AND ins.too IN (0, 3)
    WHERE p.i = (SELECT max(f.i) FROM f WHERE f.conv_id IS NOT DISTINCT FROM p.conv_id))
  GROUP BY conv_id),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0)::BIGINT AS cost,
  coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE["op11_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (
  SELECT lang, term FROM (SELECT lang, id, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 3),
c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term)
  GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
a AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(m.value, 0)::BIGINT AS value
  FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source
    GROUP BY x.lang, x.source, y.source) m ON m.lang = g.lang AND m.source = g.source AND m.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
