"""SQL for the queries of this package that SQL can express, written from the stated results."""

from __future__ import annotations

from . import quality

_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words.split()}))

OP8 = rf"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS shown
    FROM words, unnest(range(1, len(ws) - 6)) AS t(i) WHERE len(ws) >= 8
), twice AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, shown) > 1
), inside AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id
), measured AS (
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(…|[.][.][.])[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
        CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-•*‣◦]\x20'))) AS BIGINT) AS n_bullet_lines,
        CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words,
        CAST(length(body) AS BIGINT) AS n_chars, CAST(strlen(body) AS BIGINT) AS n_bytes,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM words w LEFT JOIN inside USING (doc_id)
), judged AS (
    SELECT *, concat_ws(',',
        CASE WHEN n_words < 20 THEN 'n_words' END,
        CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 'repeated_words' END,
        CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 'word_length' END,
        CASE WHEN n_words > 0 AND 10 * n_symbols > n_words THEN 'symbols' END,
        CASE WHEN 2 * n_dup_lines > n_lines THEN 'repeated_lines' END,
        CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 'open_lines' END,
        CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 'bullet_lines' END,
        CASE WHEN 50 * n_stop_words < n_words AND 100 * n_chars >= 67 * n_bytes THEN 'stop_words' END) AS broken_rules
    FROM measured
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, broken_rules = '' AS kept FROM judged
"""


OP1 = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), shown AS (
    SELECT *, length(text) + length(role)
        + len(regexp_extract_all(text, '[<\[]\\*(s>|/s>|INST\]|/INST\]|\|)'))
        + len(regexp_extract_all(role, '[<\[]\\*(s>|/s>|INST\]|/INST\]|\|)')) + 20 AS n
    FROM said
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_tokens_attached
FROM shown GROUP BY conv_id
"""


OP3 = r"""
WITH visits AS (
    SELECT page_id, k, md5(coalesce(html, '')) AS digest, length(html) AS n,
        regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest,
        1704067200 + page_id * 7919 % 31536000 AS begin,
        begin + CASE k WHEN 3 THEN -86400 ELSE k * 86400 END AS time
    FROM pages, range(4) AS r(k)
), split_up AS (
    SELECT *, page_id * 4 + k AS record_id,
        regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
        list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid)='))) AS asked,
        k = 2 AND page_id % 4 = 0 AS other,
        CASE WHEN page_id % 7 <> 3 THEN '"' || CASE WHEN k = 2 AND page_id % 4 = 0 THEN 'other' ELSE digest END || '"' END AS tag,
        CASE WHEN page_id % 5 <> 2 THEN begin - 3600 + CASE WHEN k = 2 AND page_id % 4 = 0 THEN 1 ELSE 0 END END AS changed
    FROM visits
), keyed AS (
    SELECT *, place || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS canonical_url
    FROM split_up
), joined AS (
    SELECT v.record_id, v.canonical_url, v.time, v.tag, v.changed, r.record_id AS target_id, r.time AS target_time, r.tag AS tag0,
        r.changed AS changed0, r.digest AS digest0, r.n
    FROM keyed v LEFT JOIN keyed r ON r.k = 0 AND r.canonical_url = v.canonical_url AND r.time < v.time
    WHERE v.k > 0
    QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.time DESC NULLS LAST, r.record_id DESC) = 1
), judged AS (
    SELECT *, CASE WHEN target_id IS NULL THEN 'orphan'
        WHEN tag IS NOT NULL AND tag0 IS NOT NULL THEN CASE WHEN tag = tag0 THEN 'resolved' ELSE 'mismatch' END
        WHEN changed IS NOT NULL AND changed0 IS NOT NULL THEN CASE WHEN changed = changed0 THEN 'resolved' ELSE 'mismatch' END
        ELSE 'unverified' END AS status
    FROM joined
)
SELECT record_id, canonical_url, time, status, target_id, target_time,
    CASE WHEN status = 'resolved' THEN digest0 END AS digest,
    CASE WHEN status = 'resolved' THEN 'cache-control: max-age=120; content-length: ' || coalesce(n, 0)
        || '; content-type: text/html; date: ' || time END AS headers
FROM judged
"""

OP11 = r"""
WITH judged AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS is_copy
    FROM documents
), masked AS (
    SELECT doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
        + 4 * CAST(100 * len(regexp_extract_all(body, '[A-Z]')) > 3 * length(body) AS INT)
        + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INT) + 16 * CAST(is_copy AS INT) AS mask
    FROM judged
), known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM masked LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT chr(65 + i) AS l, 1 << i AS b FROM (SELECT CAST(unnest(range(5)) AS INT) AS i)
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e WHERE (a.b | b.b | c.b | d.b | e.b) = 31
), steps AS (
    SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
        CAST(coalesce(list_sum([1 << (ascii(substr(filter_order, k, 1)) - 65) for k in range(1, step)]), 0) AS INT) AS before
    FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), counted AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""



def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_revisits": OP3,
        "op1_chat_format": OP1,
        "op8_quality_rules": OP8,
        "op11_filter_audit": OP11,
    }
