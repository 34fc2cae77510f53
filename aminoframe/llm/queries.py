"""The registered queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from . import decontaminate, exact_dedup, hard_negatives, html_text, line_dedup, mixing, phrases, quality, secrets, simhash_dedup, substring_dedup, token_counts, tokens_file

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_simhash_near_dedup": simhash_dedup.query,
    "op3_token_counts": token_counts.query,
    "op4_decontamination": decontaminate.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_mixing": mixing.query,
    "op7_quality": quality.query,
    "op8_line_dedup": line_dedup.query,
    "op9_token_files": tokens_file.query,
    "op10_html_text": html_text.query,
    "op11_phrases": phrases.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_secrets": secrets.query,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op11_phrases": phrases.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op1_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
        ),
        dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM dup),
        word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
            FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS t, least(len(w), 10) AS n
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ),
        place AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
        ),
        hit AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (t, n)),
        words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hit) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op6_mixing": """
        WITH s AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS n FROM documents GROUP BY source),
        r AS (SELECT source, CASE WHEN n > 0 THEN pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM s) * (SELECT sum(n) FROM s) / n ELSE 1.0 END AS rate FROM s),
        parts AS (SELECT source, greatest(1, ceil(rate / 16))::INT AS parts, rate / greatest(1, ceil(rate / 16)) AS mean FROM r),
        pmf AS (SELECT source, parts, k, CASE WHEN mean > 0 THEN exp(-mean + k * ln(greatest(mean, 1e-300)) - lgamma(k + 1)) ELSE (k = 0)::INT END AS p FROM parts, range(0, 120) AS ks(k)),
        cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
        u AS (
            SELECT doc_id, source, text, part, ('0x' || substr(md5('17:' || part || ':' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
            FROM (SELECT documents.*, unnest(range(1, parts + 1)) AS part FROM documents JOIN parts USING (source))
        ),
        drawn AS (SELECT doc_id, any_value(u.source) AS source, any_value(text) AS text, count(k) AS n FROM u LEFT JOIN cdf ON cdf.source = u.source AND c <= u GROUP BY doc_id)
        SELECT doc_id, source, copy::INT AS copy, n::INT AS n_copies, sha256(coalesce(text, '')) AS text_sha256
        FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn)""",
    "op8_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                 FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d)),
        bad AS (SELECT key FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM line ANTI JOIN bad USING (key) GROUP BY doc_id)
        SELECT d.doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
}
