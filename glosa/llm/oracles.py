"""DuckDB SQL for the results that SQL can express, written from the contracts.

Language fusion, secret spans and token files are held against brute force in
the tests instead.
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = """WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
),
c AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY turn NULLS LAST, role, text) AS l
  FROM t GROUP BY conv_id
),
inner_prefix AS (SELECT DISTINCT l[1:k] AS p FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
whole AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies, max(n) AS n_turns FROM c GROUP BY l)
SELECT conv_id, n_turns, n_copies,
       array_to_string(list_transform(l, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')
         AS chat
FROM whole WHERE NOT EXISTS (SELECT 1 FROM inner_prefix i WHERE i.p = whole.l)"""

OP2 = r"""WITH h AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '(?is)<!--.*?(?:-->|\z)|<script\b[^>]*(?:>.*?(?:</script\s*>|\z)|\z)|<style\b[^>]*(?:>.*?(?:</style\s*>|\z)|\z)', chr(10), 'g'),
           '(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|nav|article|section|header|footer|main|aside|title|body|head|html'
           || '|blockquote|pre|form|option|dt|dd|td|th)\b[^<>]*>', chr(10), 'g'),
           '<(?:/\s*)?[A-Za-z!?](?:(?:[^<>"'']+|"[^">]*"|''[^''>]*'')*>|[^<>]*>)', '', 'g') AS text
  FROM pages
),
p AS (
  SELECT row_number() OVER () AS k, page_id, host,
         list_filter(list_transform(string_split(text, chr(10)),
                     lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM h
),
total AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
frequent AS (
  SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) JOIN total USING (host)
  GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > 0.2 * pages
),
per_host AS (SELECT host, list(line) AS bad FROM frequent GROUP BY host),
l AS (
  SELECT page_id, host, lines, CASE WHEN bad IS NULL THEN lines
         ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept
  FROM p LEFT JOIN per_host USING (host)
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM l"""

OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS sh
  FROM w
),
classes AS (SELECT sh, min(doc_id) AS rep, count(*) AS class_size FROM s WHERE len(sh) > 0 GROUP BY sh),
u AS (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL
),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
),
component AS (SELECT node AS rep, min(seen) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(component_id, s.doc_id) AS kept, class_size
FROM s LEFT JOIN classes USING (sh) LEFT JOIN component USING (rep)"""

OP5 = """WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              CAST(((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31) + 1 AS INT), 1)),
            '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS complete
FROM d"""

OP8 = f"""WITH sized AS (
  SELECT source, doc_id, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
           / 4503599627370496.0 AS u
  FROM documents
),
ranked AS (
  SELECT *, CASE WHEN size > 0 THEN u / (1 - u) / sqrt(size) END AS rank,
         CASE WHEN size > 0 THEN row_number() OVER (PARTITION BY source, size > 0
              ORDER BY CASE WHEN size > 0 THEN u / (1 - u) / sqrt(size) END, doc_id NULLS LAST, size) END AS place
  FROM sized
),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM ranked GROUP BY source
),
levels AS (
  SELECT *, 3 * source_size AS most, (CAST(sum(source_size) OVER () AS DOUBLE)
         - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, nth
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM totals
),
targets AS (
  SELECT source, source_size, CASE WHEN level * weight > most THEN CAST(most AS DOUBLE)
         ELSE max(level) FILTER (level * weight <= most) OVER () * weight END AS target
  FROM levels
),
sources AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS copies,
         target - CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END * source_size
           AS wanted
  FROM targets
),
filled AS (
  SELECT r.*, s.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY place
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked r JOIN sources s ON s.source IS NOT DISTINCT FROM r.source WHERE size > 0
),
ends AS (
  SELECT source, min(place) AS last, min_by(wanted - before, place) AS missing
  FROM filled WHERE before + size > wanted GROUP BY source
),
m1 AS (
  SELECT f.source, arg_min({{'place': place, 'size': size}}, {{'off': abs(size - missing), 'place': place}}) AS more
  FROM filled f JOIN ends e ON e.source IS NOT DISTINCT FROM f.source
  WHERE place >= last AND abs(size - missing) < missing AND size <= missing GROUP BY f.source
),
e1 AS (
  SELECT e.*, more.place AS p1, missing - coalesce(more.size, 0) AS missing1
  FROM ends e LEFT JOIN m1 ON m1.source IS NOT DISTINCT FROM e.source
),
m2 AS (
  SELECT f.source, arg_min({{'place': place, 'size': size}}, {{'off': abs(size - missing1), 'place': place}}) AS more
  FROM filled f JOIN e1 e ON e.source IS NOT DISTINCT FROM f.source
  WHERE place >= last AND place IS DISTINCT FROM p1 AND abs(size - missing1) < missing1 AND size <= missing1 GROUP BY f.source
),
e2 AS (
  SELECT e.*, more.place AS p2, missing1 - coalesce(more.size, 0) AS missing2
  FROM e1 e LEFT JOIN m2 ON m2.source IS NOT DISTINCT FROM e.source
),
m3 AS (
  SELECT f.source, arg_min(place, {{'off': abs(size - missing2), 'place': place}}) AS p3
  FROM filled f JOIN e2 e ON e.source IS NOT DISTINCT FROM f.source
  WHERE place >= last AND place IS DISTINCT FROM p1 AND place IS DISTINCT FROM p2 AND abs(size - missing2) < missing2
  GROUP BY f.source
),
chosen AS (
  SELECT e.*, p3 FROM e2 e LEFT JOIN m3 ON m3.source IS NOT DISTINCT FROM e.source
)
SELECT r.doc_id, r.size, s.source_size, s.target,
       CAST(r.size * (s.copies + CASE WHEN r.size > 0 AND s.wanted > 0 AND
            (c.last IS NULL OR r.place < c.last OR coalesce(r.place = c.p1, false) OR coalesce(r.place = c.p2, false)
             OR coalesce(r.place = c.p3, false)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked r JOIN sources s ON s.source IS NOT DISTINCT FROM r.source
LEFT JOIN chosen c ON c.source IS NOT DISTINCT FROM r.source"""

# Scripts written without spaces between words.
UNSPACED = "".join(rf"\p{{{x}}}" for x in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan",
                                          "Javanese", "Balinese", "Tai_Le", "New_Tai_Lue", "Tai_Tham", "Tai_Viet"))
OP9 = f"""WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents
),
l AS (SELECT *, string_split(text, chr(10)) AS all_lines FROM t),
m AS (
  SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) AS win
  FROM l
),
places AS (SELECT doc_id, unnest(win) AS x, unnest(range(0, len(win))) AS i FROM m),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM places) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice CROSS JOIN (SELECT unnest(range(0, 3)) AS j) GROUP BY doc_id
),
b AS (
  SELECT m.doc_id, text, w, lines, all_lines, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN covered USING (doc_id)
),
g AS (
  SELECT *, CAST(coalesce(list_sum(list_transform(runs, lambda x: length(x))), 0) AS BIGINT) AS giant_chars,
         len(list_filter(w, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D{UNSPACED}]{{1000,}}'))) AS n_giant, len(all_lines) AS n_lines
  FROM (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D{UNSPACED}]{{1000,}}') AS runs FROM b)
),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR ((word_chars - giant_chars < 3 * (n_words - n_giant) OR word_chars - giant_chars > 10 * (n_words - n_giant))
                AND 2 * len(list_filter(regexp_extract_all(text, '[{UNSPACED}]'), lambda x: regexp_matches(x, '\\p{{L}}')))
                    <= len(regexp_extract_all(text, '\\p{{L}}')))
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < 7 * n_words
            OR 2 * len(list_filter(w, lambda x: regexp_full_match(x, '[^\\p{{Ll}}]*\\p{{Lu}}{{2}}[^\\p{{Ll}}]*'))) > n_words
            OR (n_lines >= 5 AND 10 * len(list_filter(all_lines, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) > 9 * n_lines)
            OR (n_lines >= 5 AND 10 * len(list_filter(all_lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t]*$'))) > 3 * n_lines)
            OR 2 * giant_chars > word_chars) AS kept
FROM f"""

OP10 = f"""WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
sought AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
),
shown AS (
  SELECT doc_id, m, i, array_to_string(w[i + 1:i + m], ' ') AS x
  FROM (SELECT doc_id, w, m, unnest(range(0, greatest(len(w) - m + 1, 0))) AS i
        FROM d CROSS JOIN (SELECT DISTINCT m FROM sought))
),
hits AS (SELECT doc_id, s.m, i, item_id FROM shown s JOIN sought USING (m, x)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, m)) AS j FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP11 = r"""WITH h AS (
  SELECT page_id, coalesce(url, '') AS url, contains(coalesce(url, ''), '://') AS is_url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         translate(regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params
  FROM pages
),
c AS (
  SELECT page_id, host, path, CASE WHEN is_url THEN CASE WHEN scheme IN ('http', 'https') THEN '' ELSE scheme || '://' END
         || regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':(80|443)?$', ''), '\.+$', ''), '^www\.', '')
         || regexp_replace(path, '/+$', '')
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM h
),
rules AS (
  SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                        ('allow', 'org', '/fr/')) AS r(rule_verdict, rule_host, rule_path)
),
fits AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT page_id, host, path FROM c)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
),
listed AS (SELECT DISTINCT canonical AS key FROM c WHERE regexp_matches(host, '(^|[.-])(casino|bets|pills|spam)([.-]|$)'))
SELECT page_id, host, path, rule, canonical,
       coalesce(rule_verdict, CASE WHEN key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fits USING (page_id, host, path) LEFT JOIN listed ON key = canonical"""

OP12 = """WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.k AS ak, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.k <> b.k
),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY score DESC, id) AS place FROM s WHERE same)
  WHERE place <= 5
),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ak, p.place ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.ak = p.ak AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLES = {"op1_snapshot_chats": OP1, "op2_site_lines": OP2, "op4_superminhash": OP4, "op5_warc_segments": OP5,
           "op8_pareto_mix": OP8, "op9_quality_cascade": OP9, "op10_wu_manber": OP10,
           "op11_url_filter": OP11, "op12_hard_negatives": OP12}
