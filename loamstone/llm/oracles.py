"""DuckDB SQL for those registered queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WS = r"[\x20\x09-\x0D]"

OP1 = rf"""
WITH parsed AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed
), bare AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM hosts
), split AS (
  SELECT *, string_split(bare, '.') AS parts, regexp_matches(bare, '^[0-9.]+$|^\[') AS address,
         len(parts) > 2 AND regexp_matches(parts[-1], '^[a-z][a-z]$') AND parts[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gouv',
         'gov', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'sch') AS wide
  FROM bare
), named AS (
  SELECT *, CASE WHEN address THEN bare WHEN wide THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
         CASE WHEN address THEN bare WHEN wide THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix
  FROM split
), h AS (
  SELECT bare, domain, suffix, count(quality) AS n, coalesce(sum(quality), 0) AS good
  FROM named LEFT JOIN labels ON page_id = doc_id GROUP BY ALL
), overall AS (
  SELECT (coalesce(sum(good), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS m FROM h
), s AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT m FROM overall) AS m FROM h GROUP BY suffix
), s1 AS (
  SELECT 1 / least(greatest(sum((good - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)), 0.001), 0.999) - 1 AS v FROM s WHERE n > 0
), d AS (
  SELECT h.domain, sum(h.n) AS n, sum(h.good) AS good, any_value((s.good + v * s.m) / (s.n + v)) AS m
  FROM h JOIN s ON h.suffix = s.suffix, s1 GROUP BY h.domain
), s2 AS (
  SELECT 1 / least(greatest(sum((good - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)), 0.001), 0.999) - 1 AS v FROM d WHERE n > 0
), b AS (
  SELECT h.bare, h.n, h.good, (d.good + v * d.m) / (d.n + v) AS m FROM h JOIN d ON h.domain = d.domain, s2
), s3 AS (
  SELECT 1 / least(greatest(sum((good - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)), 0.001), 0.999) - 1 AS v FROM b WHERE n > 0
), post AS (
  SELECT bare, good + v * m AS x, n - good + v * (1 - m) AS y FROM b, s3
), sided AS (
  SELECT bare, CASE WHEN swap THEN y ELSE x END AS a, CASE WHEN swap THEN x ELSE y END AS b, swap
  FROM (SELECT *, 0.5 > (x + 1) / (x + y + 2) AS swap FROM post)
), fraction AS (
  SELECT bare, swap, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a + b) * ln(0.5)) / a / list_reduce(
      list_prepend(1.0::DOUBLE, list_transform(range(2000, 0, -1), lambda m: CASE WHEN m % 2 = 1
        THEN -(a + m // 2) * (a + b + m // 2) * 0.5 / ((a + 2 * (m // 2)) * (a + 2 * (m // 2) + 1))
        ELSE (m // 2) * (b - m // 2) * 0.5 / ((a + m - 1) * (a + m)) END)), lambda f, d: 1 + d / f) AS i
  FROM sided
), upper_bound AS (
  SELECT bare, (CASE WHEN swap THEN 1 - i ELSE i END) > 0.95 AS bad FROM fraction
), rules(action, rule, rh, rp) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
         ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
)
SELECT n.page_id, n.host, n.path,
       (SELECT arg_max(rule, length(rule)) FROM rules WHERE (n.host = rh OR ends_with(n.host, '.' || rh)) AND starts_with(n.path, rp)) AS rule,
       coalesce((SELECT arg_max(action, length(rule)) FROM rules WHERE (n.host = rh OR ends_with(n.host, '.' || rh)) AND starts_with(n.path, rp)),
                CASE WHEN u.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN upper_bound u ON n.bare = u.bare
"""

OP2 = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, least(len(w), 1)))) AS i FROM dw)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sh a JOIN n na ON a.doc_id = na.doc_id JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n nb ON b.doc_id = nb.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a
), top AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT dw.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(dw.doc_id, coalesce(m, dw.doc_id)) AS component_id,
       dw.doc_id = least(dw.doc_id, coalesce(m, dw.doc_id)) AS kept
FROM dw LEFT JOIN n ON dw.doc_id = n.doc_id LEFT JOIN top ON dw.doc_id = top.a
"""

OP3 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS body,
         length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + head + 1 + body + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP4 = rf"""
WITH lines AS (
  SELECT d.doc_id, d.rowid AS r, u.pos, u.line,
         translate(regexp_replace(regexp_replace(u.line, '^{WS}+', ''), '{WS}+$', ''), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS text FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
                       generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u
), hot AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE h.key IS NOT NULL AND h.last <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos)
              FILTER (WHERE h.key IS NULL OR h.last = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h ON l.key = h.key
GROUP BY l.r, l.doc_id
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), top AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(top.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(top.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN top ON e.vec_id = top.a
"""

OP8 = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS span, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0)
), grams AS (
  SELECT r, s.span, i, array_to_string(w[i:i + s.span - 1], ' ') AS g
  FROM (SELECT r, w, span, unnest(generate_series(1, len(w) - span + 1)) AS i
        FROM dw, (SELECT DISTINCT span FROM win) WHERE len(w) >= span) s
), hits AS (
  SELECT r, i, g.span, item_id FROM grams g JOIN win ON g.span = win.span AND g.g = win.g
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + span - 1)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.r = words.r LEFT JOIN found ON dw.r = found.r
"""

OP9 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 3.0::DOUBLE AS cap
  FROM per
), levels AS (
  SELECT *, row_number() OVER o AS rank,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM weighed WINDOW o AS (ORDER BY cap / weight, place)
), aimed AS (
  SELECT source, source_size,
         least(cap, weight * (SELECT arg_min(lvl, rank) FROM levels WHERE cap / weight >= lvl)) AS target
  FROM levels
), runs AS (
  SELECT row_number() OVER () AS r, s.doc_id, s.source, s.size, a.source_size, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('0|' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
), epochs AS (
  SELECT source, source_size, round(target)::BIGINT AS words,
         unnest(generate_series(0, (round(target)::BIGINT - 1) // source_size)) AS epoch
  FROM aimed WHERE source_size > 0 AND round(target) > 0
), blocks AS (
  SELECT *, least(4096, source_size - block * 4096) AS n, least(source_size, words - epoch * source_size) AS goal
  FROM (SELECT *, unnest(generate_series(0, (source_size - 1) // 4096)) AS block FROM epochs)
), drawn AS (
  SELECT source, block, CASE WHEN goal = source_size THEN n ELSE greatest(0, least(n, goal - coalesce(sum(n) OVER
           (PARTITION BY source, epoch ORDER BY md5('0|' || coalesce(source, '') || '|' || epoch || '|' || block)
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS upto
  FROM blocks
), pieces AS (
  SELECT r, sum(greatest(0, least(o.block * 4096 + d.upto, o.start + o.size) - greatest(o.block * 4096, o.start))) AS taken
  FROM (SELECT *, unnest(generate_series(start::BIGINT // 4096, (start::BIGINT + size - 1) // 4096)) AS block FROM runs WHERE size > 0) o
  JOIN drawn d ON o.source IS NOT DISTINCT FROM d.source AND o.block = d.block GROUP BY r
)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target, coalesce(taken, 0)::BIGINT AS taken
FROM runs LEFT JOIN pieces USING (r)
"""

OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN x.doc_id > min(x.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM texts x LEFT JOIN marks ON x.doc_id = marks.doc_id
), l(x) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), grouped AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, f
), gone AS (
  SELECT *, CASE WHEN f = '' THEN 6 ELSE list_min(list_transform(string_split(f, ''), lambda c: strpos(o, c))) END AS place FROM grouped, orders
), steps AS (
  SELECT part, o AS filter_order, s AS step, coalesce(sum(n) FILTER (WHERE place > s), 0) AS kept, coalesce(sum(n) FILTER (WHERE place = s), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE place < s AND contains(f, o[s])), 0) AS redundant, coalesce(sum(n) FILTER (WHERE f = o[s]), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE place = s), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE place = s), 0) AS toxic_lost
  FROM gone, generate_series(1, 5) g(s) GROUP BY part, o, s
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley
FROM steps
"""

ORACLES: dict[str, str] = {
    "op1_url_filter": OP1,
    "op2_near_dup": OP2,
    "op3_chat_format": OP3,
    "op4_line_dedup": OP4,
    "op5_vector_join": OP5,
    "op8_decontaminate": OP8,
    "op9_mix_sources": OP9,
    "op13_filter_audit": OP13,
}
