"""The same results in DuckDB SQL, written on their own from the rules of each operator."""

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
marked AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM marked) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
    coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)
),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 60 * word_chars THEN 32 ELSE 0 END)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""

ABLATION = f"""
WITH ledger AS ({QUALITY}),
rules AS (SELECT unnest(['few_words', 'repeated_words', 'symbols', 'repeated_lines', 'word_length', 'shouting']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT rule, (count(*) FILTER (WHERE failed_bits & bit <> 0))::BIGINT AS fails,
  (count(*) FILTER (WHERE failed_bits = bit))::BIGINT AS fails_only_this,
  (count(*) FILTER (WHERE failed_bits = 0 OR failed_bits = bit))::BIGINT AS kept_without
FROM ledger, rules GROUP BY rule
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
),
k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / greatest(0.25, CASE WHEN length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) > 0
        THEN length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::DOUBLE
        ELSE 1.0 END) AS key
  FROM d
),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER p, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM f WINDOW p AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
c AS (SELECT arg_min(level, full_at * 1e6 + rank) FILTER (level < full_at) AS common FROM l),
t AS (SELECT source, source_size, CASE WHEN level >= full_at THEN 2.0::DOUBLE * source_size ELSE common * weight END AS target FROM l, c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""

URLLISTS = r"""
WITH c AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '[.]+$', ''), '') AS host,
    DATE '2024-01-01' + ((page_id * 7919) % 365)::INT AS fetched_on
  FROM pages
),
hosts AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
sites AS (SELECT entry, md5(entry) AS h FROM (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)[.]', '') AS entry FROM hosts)),
d AS (
  SELECT entry, CASE WHEN ('0x' || substr(h, 7, 1))::INT < 8 THEN 'spam' ELSE 'adult' END AS list, ('0x' || substr(h, 3, 4))::INT % 365 AS first,
    ('0x' || substr(h, 10, 1))::INT AS d10, ('0x' || substr(h, 11, 1))::INT AS d11, ('0x' || substr(h, 8, 2))::INT % 120 AS stay
  FROM sites WHERE ('0x' || substr(h, 1, 2))::INT < 96
),
log AS (
  SELECT list, 'domain' AS kind, entry, 1 AS onn, first AS day FROM d
  UNION ALL SELECT list, 'domain', entry, 0, first + 1 + stay FROM d WHERE d10 < 10
  UNION ALL SELECT list, 'domain', entry, 1, first + 200 FROM d WHERE d11 < 4
  UNION ALL SELECT 'phish', 'host', host, 1, ('0x' || substr(md5(host), 3, 4))::INT % 365 FROM hosts WHERE ('0x' || substr(md5(host), 1, 2))::INT < 48
),
states AS (SELECT list, kind, entry, DATE '2024-01-01' + day::INT AS dated, min(onn) AS onn FROM log GROUP BY ALL),
pairs AS (
  SELECT DISTINCT c.host, c.fetched_on, s.list, s.kind, s.entry
  FROM (SELECT DISTINCT host, fetched_on FROM c WHERE host IS NOT NULL) c JOIN (SELECT DISTINCT list, kind, entry FROM states) s
    ON (s.kind = 'host' AND s.entry = c.host) OR (s.kind = 'domain' AND (s.entry = c.host OR ends_with(c.host, '.' || s.entry)))
),
hits AS (
  SELECT p.host, p.fetched_on, p.list FROM pairs p ASOF JOIN states s
    ON p.list = s.list AND p.kind = s.kind AND p.entry = s.entry AND p.fetched_on >= s.dated
  WHERE s.onn = 1
),
named AS (SELECT host, fetched_on, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hits GROUP BY ALL)
SELECT c.page_id, c.host, c.fetched_on, n.lists, n.lists IS NOT NULL AS blocked FROM c LEFT JOIN named n USING (host, fetched_on)
"""

SNAPSHOTS = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY place) AS turns FROM p GROUP BY conv_id),
heads AS (SELECT DISTINCT turns[1:k] AS head FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_equal, turns FROM c
  WHERE NOT EXISTS (SELECT 1 FROM heads WHERE heads.head = c.turns) GROUP BY n_turns, turns
)
SELECT k.conv_id, ((place - 1) // 256)::BIGINT AS part, k.n_turns::BIGINT AS n_turns, k.n_equal,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM kept k JOIN p USING (conv_id) GROUP BY k.conv_id, part, k.n_turns, k.n_equal
"""

PRODUCTS = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS xs FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.xs, c.xs)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.xs) = len(c.xs) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
