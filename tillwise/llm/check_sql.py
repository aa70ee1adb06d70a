"""DuckDB statements that check the registered queries which SQL can express."""

EXACT_DEDUP = r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       text_sha256
FROM hashed
WINDOW same AS (PARTITION BY text_sha256)
"""

# Base32 by groups of five hexadecimal digits, which are four letters of five bits each.
WARC = r"""
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
    FROM pages
), spelled AS (
    SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST(((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT),
               1)), 'string_agg', '') AS payload_digest
    FROM hashed
), answered AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS answer FROM spelled
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = answer THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> answer THEN answer END AS refers_to
FROM answered
"""

FILL_IN_MIDDLE = r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
    FROM documents
), drawn AS (
    SELECT doc_id, text, tokens, len(tokens) AS n,
           CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4
    FROM hashed
), cut AS (
    SELECT doc_id, text, tokens, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS prefix,
           array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix
    FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

# Sources in order of what they have by weight: the first within its share settles the level for all.
MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, ''))) AS mark
    FROM documents
), sums AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sized GROUP BY source
), ordered AS (
    SELECT source, source_size, weight, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM sums
), running AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS rest,
           sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS parts
    FROM ordered
    WINDOW earlier AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT rest, parts FROM running WHERE 3 * source_size * parts >= rest * weight ORDER BY place LIMIT 1
), targets AS (
    SELECT source, source_size,
           CASE WHEN 3 * source_size * parts < rest * weight THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(rest AS DOUBLE) * weight / CAST(parts AS DOUBLE) END AS target
    FROM sums CROSS JOIN level
), rates AS (
    SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), digests AS (
    SELECT s.doc_id, s.size, r.source, r.source_size, r.target, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS chance,
           sha256('mix 0:' || mark) || sha256('mix 1:' || mark) AS hex
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
), draws AS (
    SELECT *, list_transform(range(0, 16), lambda k: CASE WHEN CAST('0x' || substr(hex, CAST(1 + 8 * k AS BIGINT), 8) AS BIGINT) / 4294967296.0 < chance
                                                  THEN 1 ELSE 0 END) AS extra
    FROM digests
), tried AS (
    SELECT source, k, abs(max(whole) * max(source_size) + sum(size * extra[k + 1]) - max(target)) AS off
    FROM draws CROSS JOIN (SELECT unnest(range(0, 16)) AS k) GROUP BY source, k
), best AS (
    SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1
)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(d.size * (d.whole + d.extra[b.k + 1]) AS BIGINT) AS taken,
       d.source, CAST(d.whole + d.extra[b.k + 1] AS BIGINT) AS copies
FROM draws d JOIN best b ON d.source IS NOT DISTINCT FROM b.source
"""
