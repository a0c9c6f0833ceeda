"""DuckDB SQL for the queries whose whole result SQL can express."""

OP4 = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS number
  FROM rows GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(number % 3 + 1)::INT]::DOUBLE AS weight FROM sources),
levels AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, number
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2 * source_size / weight, number
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT l.*, coalesce(least(weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, number LIMIT 1),
                             cap::DOUBLE), cap::DOUBLE) AS target
  FROM levels l),
liked AS (
  SELECT source, sum(size * CAST(floor(16777216 / (size + 256)::DOUBLE) AS BIGINT))::BIGINT AS liking FROM rows GROUP BY source),
shares AS (
  SELECT r.doc_id, r.size, r.u, t.source_size, t.target, t.number,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS share,
         CASE WHEN t.source_size > 0 THEN l.liking::DOUBLE / t.source_size ELSE 0 END AS liked
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source JOIN liked l ON r.source IS NOT DISTINCT FROM l.source),
expected AS (
  SELECT *, share + 0.5::DOUBLE * least(share, 2.0::DOUBLE - share) * (floor(16777216 / (size + 256)::DOUBLE) - liked) / 65536.0::DOUBLE AS e FROM shares),
parts AS (SELECT *, floor(e) AS whole, e - floor(e) AS part FROM expected),
odds AS (
  SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q FROM parts),
ranked AS (
  SELECT *, q / (1 + q) AS z, target - sum(size * whole) OVER (PARTITION BY number) AS rest FROM odds),
upto AS (
  SELECT *, sum(size) OVER (PARTITION BY number ORDER BY z, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words
  FROM ranked WHERE z IS NOT NULL AND size > 0),
cut AS (
  SELECT number, any_value(rest) - coalesce(max(words) FILTER (words <= rest), 0) AS gap FROM upto GROUP BY number),
fitting AS (
  SELECT u.*, gap, sum(size) OVER (PARTITION BY u.number ORDER BY z, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS more
  FROM upto u JOIN cut c ON u.number = c.number WHERE words > rest AND size <= gap),
cut2 AS (
  SELECT c.number, c.gap - coalesce((SELECT max(more) FROM fitting f WHERE f.number = c.number AND more <= f.gap), 0) AS gap FROM cut c),
filler AS (
  SELECT u.number, arg_min({'z': u.z, 'id': u.doc_id, 'size': u.size}, (abs(u.size - c.gap), u.z, u.doc_id, u.size)) AS f
  FROM upto u JOIN cut2 c ON u.number = c.number LEFT JOIN fitting x ON x.doc_id = u.doc_id
  WHERE u.words > u.rest AND NOT coalesce(x.more <= x.gap, false) AND abs(u.size - c.gap) < c.gap GROUP BY u.number),
chosen AS (
  SELECT r.*, r.whole + CASE WHEN r.size > 0 AND (coalesce(u.words <= r.rest, false) OR coalesce(x.more <= x.gap, false) OR coalesce(f.f = {'z': r.z, 'id': r.doc_id, 'size': r.size}, false)) THEN 1 ELSE 0 END AS n
  FROM ranked r LEFT JOIN upto u ON u.doc_id = r.doc_id LEFT JOIN fitting x ON x.doc_id = r.doc_id LEFT JOIN filler f ON f.number = r.number)
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken, n::INT AS copies
FROM chosen
"""

OP1 = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

OP5 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS start, words FROM docs WHERE len(words) >= 13),
keyed AS (
  SELECT doc_id, start, array_to_string(words[start:start + 12], ' ') AS w FROM windows),
firsts AS (SELECT w, min(doc_id) AS first FROM keyed GROUP BY w),
gone AS (
  SELECT DISTINCT k.doc_id, unnest(range(k.start, k.start + 13)) AS pos
  FROM keyed k JOIN firsts f USING (w) WHERE f.first < k.doc_id),
each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
kept AS (
  SELECT e.doc_id, count(*) AS n, coalesce(string_agg(word, ' ' ORDER BY e.pos), '') AS text
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN w ELSE []::VARCHAR[] END AS s
  FROM docs),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (n + m - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
labels AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.label, s.doc_id) AS component_id,
       s.doc_id = coalesce(l.label, s.doc_id) AS kept
FROM sets s LEFT JOIN labels l ON l.node = s.doc_id
"""

OP8 = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
         16 + len(role) + len(text) + len(regexp_replace(role || text, '[^\\<\[|]', '', 'g')) AS chars
  FROM raw),
started AS (
  SELECT *, pos = 1 AND role = 'system' AS is_system,
         coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         coalesce(max(CASE WHEN pos = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS s_tokens,
         coalesce(max(CASE WHEN pos = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id), 0) AS s_chars
  FROM numbered),
roomed AS (SELECT *, greatest(32, floor((512 - 128 - s_tokens) / 2)) AS room FROM started),
opened AS (
  SELECT *, coalesce(pos = 1 OR tokens > room OR lag(tokens) OVER c > room
                     OR floor(start / room) <> floor(lag(start) OVER c / room), false) AS opens,
         coalesce(sum(CASE WHEN NOT is_system THEN chars END)
                  OVER (PARTITION BY conv_id ORDER BY start RANGE BETWEEN 128 PRECEDING AND 1 PRECEDING), 0) AS old_chars
  FROM roomed WINDOW c AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + sum(CASE WHEN opens AND pos > 1 THEN s_chars + old_chars ELSE 0 END))::BIGINT AS formatted_chars
FROM opened GROUP BY conv_id
"""

OP13 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
size AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM words WHERE len(t) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, size GROUP BY term),
scored AS (
  SELECT a.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN weights w USING (term) JOIN postings p USING (term), size
  GROUP BY a.item_id, p.doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
