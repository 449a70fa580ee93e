"""SQL that gives the same rows as those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^ \t\n\x0B\f\r]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, 2 * length(text) - length(regexp_replace(text, '[\\<\[|]', '', 'g')) AS escaped, 2 * length(role) - length(regexp_replace(role, '[\\<\[|]', '', 'g')) AS escaped_role FROM turns
), formatted AS (
  SELECT *, escaped + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 11 + escaped_role END AS chars FROM sized
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - chars AS before FROM formatted
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples, CAST(coalesce(sum(before) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars
FROM placed GROUP BY conv_id"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d),
windows AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM starts),
lowest AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS i FROM windows JOIN lowest USING (h) WHERE first_id < doc_id),
gone_by_doc AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN gone_by_doc USING (doc_id)),
words AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed, CASE WHEN len(gone) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS left_over FROM kept)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256 FROM words"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM d),
each_one AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM each_one a JOIN each_one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (nx + ny - c)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, s.y FROM reach r JOIN steps s ON s.x = r.y),
component AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN component USING (doc_id)"""

MIXING = f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, CAST(len({_WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM docs GROUP BY source),
rounds AS (
  SELECT 0 AS r, source, source_size, CAST(w AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap, false AS filled, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources
  UNION ALL
  SELECT r + 1, source, source_size, w, cap, filled OR cap <= (total - coalesce(sum(cap) FILTER (filled) OVER (), 0)) / nullif(sum(w) FILTER (NOT filled) OVER (), 0) * w, total FROM rounds WHERE r < (SELECT count(*) FROM sources)
),
level AS (SELECT *, (total - coalesce(sum(cap) FILTER (filled) OVER (), 0)) / nullif(sum(w) FILTER (NOT filled) OVER (), 0) AS water FROM rounds WHERE r = (SELECT count(*) FROM sources)),
targets AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE least(cap, water * w) END AS target FROM level),
wanted AS (SELECT d.doc_id, d.size, t.*, coalesce(target / nullif(source_size, 0), 0) AS e, (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM docs d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source),
parts AS (SELECT *, floor(e) AS whole, e - floor(e) AS p, (size * 1024) // (size + 256) AS z FROM wanted),
means AS (SELECT *, CAST(sum(z * size) OVER (PARTITION BY source) AS DOUBLE) / nullif(source_size * 1024.0::DOUBLE, 0) AS mean FROM parts),
odds AS (SELECT *, p + 0.9::DOUBLE * least(p / mean, (1 - p) / (1 - mean)) * (z / 1024.0::DOUBLE - mean) AS pi FROM means),
ranked AS (SELECT *, target - whole * source_size AS room, sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - pi) / pi) END NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS after FROM odds)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(CASE WHEN size = 0 THEN 0 ELSE (whole + CASE WHEN p > 0 AND after - room <= room - (after - size) THEN 1 ELSE 0 END) * size END AS BIGINT) AS taken FROM ranked"""

DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT lang, source, doc_id, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
langs AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.lang_n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::BIGINT AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source),
every AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 1) // (t.n + l.v) AS p, 1 + 1000000000 * (k.lang_n + 1) // (l.n + l.v) AS q FROM groups g JOIN kept k USING (lang) JOIN totals t USING (lang, source) JOIN langs l USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM every WHERE c > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10"""
