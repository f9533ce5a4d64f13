"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from . import chat

_RESERVED = "|".join(chat.RESERVED)

SQL = {
    "op4_chat_formatting": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '[<\[]\\*(?:{_RESERVED})')) AS role_len,
         length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:{_RESERVED})')) AS text_len,
         coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS opens
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(text_len + CASE WHEN opens THEN {len(chat.OPEN + chat.SEP + chat.CLOSE)} + role_len ELSE {len(chat.PART)} END)::BIGINT AS formatted_chars,
       count(*) FILTER (WHERE opens)::BIGINT AS n_blocks
FROM e GROUP BY conv_id""",
    "op2_line_dedup": r"""
WITH RECURSIVE l AS (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS line_text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), m AS (
  SELECT doc_id, line, list_transform(regexp_extract_all(line_text, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9@]|://') THEN '<*>' ELSE t END) AS t FROM l
), o AS (SELECT doc_id, line, array_to_string(t, ' ') AS masked, t FROM m WHERE len(t) > 0),
p AS (SELECT doc_id, line, t, min((doc_id, line)) OVER (PARTITION BY masked) AS id FROM o),
d AS (SELECT DISTINCT id, t, len(t) AS n, len(t) // 10 AS k FROM p),
b AS (SELECT id, t, n, k, t[1:2] AS lead, b, t[n * b // (k + 1) + 1:n * (b + 1) // (k + 1)] AS block FROM d, range(k + 1) r(b)),
h AS (SELECT n, lead, b, block, min(id) AS head FROM b GROUP BY ALL HAVING count(*) > 1),
e AS (
  SELECT DISTINCT h.head AS u, b.id AS v FROM b JOIN h ON b.n = h.n AND b.lead = h.lead AND b.b = h.b AND b.block = h.block JOIN d x ON x.id = h.head
  WHERE b.id <> h.head AND len(list_filter(range(b.n), lambda i: b.t[i + 1] <> x.t[i + 1])) <= b.k
), o1 AS (SELECT id, i, t[1:i] AS a, t[i + 2:] AS z FROM d, range(2, n) r(i) WHERE n >= 5),
o2 AS (SELECT i, a, z, min(id) AS head FROM o1 GROUP BY ALL HAVING count(*) > 1),
y AS (SELECT u, v FROM e UNION SELECT o2.head, o1.id FROM o1 JOIN o2 ON o1.i = o2.i AND o1.a = o2.a AND o1.z = o2.z WHERE o1.id <> o2.head),
u AS (SELECT u, v FROM y UNION ALL SELECT v, u FROM y),
r AS (SELECT id AS node, id AS root FROM d UNION SELECT u.v, r.root FROM r JOIN u ON u.u = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
q AS (SELECT doc_id, line, root FROM p JOIN c ON c.node = p.id),
f AS (SELECT root, min((doc_id, line)) AS first FROM q GROUP BY root HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT DISTINCT doc_id, line FROM q JOIN f USING (root) WHERE (doc_id, line) <> first)
SELECT d.doc_id, d.n_lines, count(g.line)::BIGINT AS n_dropped, coalesce(string_agg(g.line::VARCHAR, ',' ORDER BY g.line), '') AS dropped
FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines FROM documents) d LEFT JOIN g USING (doc_id)
GROUP BY d.doc_id, d.n_lines""",
    "op5_secret_scan": r"""
WITH m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, 12 AS least, regexp_split_to_array(text, a) AS gaps, regexp_extract_all(text, a) AS found, regexp_extract_all(text, a, 2) AS kept
  FROM (SELECT doc_id, coalesce(text, '') AS text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS a FROM documents)
  UNION ALL
  SELECT doc_id, 'access', 1, 18, regexp_split_to_array(coalesce(text, ''), 'AKIA[A-Z0-9]+'), regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') FROM documents
  UNION ALL
  SELECT doc_id, 'hex', 2, 16, regexp_split_to_array(coalesce(text, ''), '[0-9a-f]{16,}'), regexp_extract_all(coalesce(text, ''), '[0-9a-f]{16,}'), regexp_extract_all(coalesce(text, ''), '[0-9a-f]{16,}') FROM documents
  UNION ALL
  SELECT doc_id, kind, rank, 1, regexp_split_to_array(text, pattern), regexp_extract_all(text, pattern), regexp_extract_all(text, pattern)
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), (VALUES
    ('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), ('jwt', 4, 'eyJ[A-Za-z0-9_-]{8,250}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'),
    ('login', 5, '[a-z][a-z0-9+.-]{0,31}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@'), ('code_host', 6, 'gh[pousr]_[A-Za-z0-9]{20,}')) r(kind, rank, pattern)
), s AS (
  SELECT doc_id, kind, rank, least, unnest(found) AS hit, unnest(kept) AS kept, generate_subscripts(found, 1) AS i, gaps, found FROM m WHERE len(found) > 0
), e AS (
  SELECT doc_id, kind, rank, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS lo, length(hit) AS n
  FROM s WHERE length(kept) >= least
), j AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || lo || ':' || (lo + n), ',' ORDER BY lo, rank) AS spans,
         string_agg(kind || ':' || lo || ':' || (lo + n), ',' ORDER BY lo, rank) FILTER (WHERE rank < 3) AS base
  FROM e GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN j USING (doc_id)""",
    "op7_decontamination": r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 10], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), pos AS (
  SELECT doc_id, w, unnest(range(len(w))) AS i FROM dw
), occ AS (
  SELECT p.doc_id, p.i, win.item_id, win.n FROM pos p, (SELECT DISTINCT n FROM win) l, win
  WHERE p.i + l.n <= len(p.w) AND win.n = l.n AND win.win = array_to_string(p.w[p.i + 1:p.i + l.n], ' ')
), hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occ, range(10) r(k) WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY ALL""",
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), b AS (
  SELECT c, n, c - c % 20 AS base, list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [ascii(substring(c::VARCHAR, i::INTEGER, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), h AS (
  SELECT c, n, base, xor(list_reduce(steps, lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h FROM b
), l AS (SELECT h.*, least(h.h, coalesce(x.n, 0)) AS led FROM h LEFT JOIN h x ON x.c = h.base),
r AS (
  SELECT l.c, t.pos, role, text FROM l JOIN t ON t.c = l.base AND t.pos <= l.h
  UNION ALL SELECT l.c, t.pos - h + led, role, text FROM l JOIN t USING (c) WHERE t.pos > h
), p AS (
  SELECT c, pos AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY pos) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM l
), e AS (SELECT *, sha256(k) AS node, sha256(left(k, length(k) - 64)) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
n AS (
  SELECT node, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY node, d
), k AS (SELECT up, count(*) AS n FROM n WHERE d > 0 GROUP BY up),
o AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.node),
s AS (SELECT e.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * o.words) AS saved FROM o JOIN e ON e.c = o.conv_id AND e.d <= o.d GROUP BY e.node)
SELECT o.conv_id, o.d::BIGINT AS depth, x.conv_id AS parent_conv_id, o.n_convs, o.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM o JOIN s USING (node) LEFT JOIN o x ON o.d > 0 AND x.node = o.up""",
    "op12_top_inner": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, list_inner_product(q.z, v.z)::BIGINT AS score FROM v q JOIN v ON v.row <> q.row WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL
), c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, docs),
s AS (
  SELECT item_id, row, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), c WHERE doc_id IS NOT NULL GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
}
