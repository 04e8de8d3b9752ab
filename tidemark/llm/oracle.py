"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

ORACLE: dict[str, str] = {}

ORACLE["op1_line_dedup"] = r"""
WITH cut AS (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?] |\n)', '\1' || chr(1), 'g'), chr(1)) AS u FROM documents
), units AS (
    SELECT doc_id, k, raw, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS p,
        CAST(sum(length(raw)) OVER up - length(raw) AS BIGINT) AS start, CAST(sum(length(raw)) OVER up AS BIGINT) AS stop,
        sum(CAST(raw LIKE '%' || chr(10) AS INTEGER)) OVER up - CAST(raw LIKE '%' || chr(10) AS INTEGER) AS line
    FROM (SELECT doc_id, k, u[k] AS raw FROM cut, unnest(range(1, len(u) + 1)) t(k))
    WINDOW up AS (PARTITION BY doc_id ORDER BY k)
), solid AS (
    SELECT *, length(p) AS n, row_number() OVER up AS i, sum(length(p)) OVER up AS upto FROM units WHERE p <> ''
    WINDOW up AS (PARTITION BY doc_id ORDER BY k)
), stretches AS (
    SELECT a.doc_id, a.i, b.i AS j FROM solid a ASOF JOIN solid b ON a.doc_id = b.doc_id AND a.upto - a.n + 150 <= b.upto
    UNION SELECT doc_id, min(i), max(i) FROM solid GROUP BY doc_id, line HAVING sum(n) >= 150
), named AS (
    SELECT s.doc_id, s.i, s.j, string_agg(p, chr(1) ORDER BY u.i) AS words, min(start) AS start, max(stop) AS stop
    FROM stretches s JOIN solid u ON u.doc_id = s.doc_id AND u.i BETWEEN s.i AND s.j GROUP BY s.doc_id, s.i, s.j
), later AS (
    SELECT doc_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS r FROM named) WHERE r > 1
), judged AS (
    SELECT u.*, EXISTS (SELECT 1 FROM later l WHERE l.doc_id = u.doc_id AND l.start <= u.start AND u.stop <= l.stop) AS gone
    FROM units u
), runs AS (
    SELECT *, sum(CAST(gone <> before AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY k) AS run
    FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), gone) AS before FROM judged)
), spans AS (
    SELECT doc_id, string_agg(span, ',' ORDER BY start) AS removed
    FROM (SELECT doc_id, min(start) AS start, min(start) || '-' || max(stop) AS span FROM runs WHERE gone GROUP BY doc_id, run) GROUP BY doc_id
), per_doc AS (
    SELECT doc_id, count(*) FILTER (WHERE gone AND p <> '') AS n_removed,
        CAST(coalesce(sum(length(raw)) FILTER (WHERE gone), 0) AS BIGINT) AS chars_removed,
        coalesce(string_agg(raw, '' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(chars_removed, 0) AS chars_removed, coalesce(removed, '') AS removed, kept
FROM documents d LEFT JOIN per_doc USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

ORACLE["op4_prefix_decontamination"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS s
    FROM i, unnest(range(1, greatest(2, len(w) - 8))) t(k) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win), places AS (
    SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
    FROM d, lens, unnest(range(1, len(w) - n + 2)) t(k)
), hit AS (SELECT doc_id, k, n, item_id FROM places JOIN win USING (n, s)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE["op2_divergence_quality"] = r"""
WITH d AS (
    SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) u(k)
), twice AS (
    SELECT doc_id, k FROM windows JOIN (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1) USING (doc_id, s)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM twice) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
    SELECT doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), classes AS (
    SELECT doc_id, lang, unnest(['a', 'A', 'x', '0', '_', '.', 'o']) AS c, unnest([a, u, x, n, s, p, length(t) - a - u - x - n - s - p]) AS n
    FROM (SELECT doc_id, lang, t, length(regexp_replace(t, '[^a-z]', '', 'g')) AS a, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS u,
        length(regexp_replace(t, '[a-zA-Z]|[^\p{L}]', '', 'g')) AS x, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n,
        length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS s, length(regexp_replace(t, '[^.,;:!?]', '', 'g')) AS p FROM d)
), forms AS (
    SELECT doc_id, lang, trim(lower(f), '.,;:!?"''()') AS f FROM (SELECT doc_id, lang, unnest(w) AS f FROM d)
), common AS (
    SELECT lang, f FROM (SELECT lang, f, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, f) AS r FROM forms WHERE f <> '' GROUP BY lang, f) WHERE r <= 30
), folded AS (
    SELECT doc_id, lang, coalesce(c.f, '') AS c, count(*) AS n FROM forms LEFT JOIN common c USING (lang, f) GROUP BY ALL
), counts AS (SELECT 1 AS kind, * FROM classes UNION ALL SELECT 2, * FROM folded
), share AS (SELECT kind, doc_id, lang, c, n / sum(n) OVER (PARTITION BY kind, doc_id) AS p FROM counts WHERE n > 0
), reference AS (SELECT kind, lang, c, sum(n) / sum(sum(n)) OVER (PARTITION BY kind, lang) AS q FROM counts GROUP BY kind, lang, c HAVING sum(n) > 0
), pairs AS (
    SELECT kind, doc_id, coalesce(p, 0) AS p, q FROM (SELECT DISTINCT kind, doc_id, lang FROM share) JOIN reference USING (kind, lang) LEFT JOIN share USING (kind, doc_id, lang, c)
), js AS (
    SELECT kind, doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + q * log2(2 * q / (p + q))) / 2)) AS js FROM pairs GROUP BY kind, doc_id
), judged AS (
    SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CASE WHEN n_words >= 50 THEN a.js END AS class_js, CASE WHEN n_words >= 50 THEN b.js END AS word_js
    FROM base LEFT JOIN js a ON a.doc_id = base.doc_id AND a.kind = 1 LEFT JOIN js b ON b.doc_id = base.doc_id AND b.kind = 2
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(class_js <= 0.3 AND word_js <= 0.45, true) AS kept,
    round(class_js, 4) AS class_distance, round(word_js, 4) AS word_distance
FROM judged
"""
