"""The registered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from ..config import dealt
from . import bpe_codec, decontamination, license_scan, line_dedup, pii, quality_rules, simhash, substring_dedup, token_count, warc
from .common import table


def op1_token_counts(spark, sf_dir):
    return token_count.token_counts(dealt(table(spark, sf_dir, "documents")))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(dealt(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op4_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark, sf_dir):
    return bpe_codec.round_trip(dealt(table(spark, sf_dir, "documents")))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op7_quality_rules(spark, sf_dir):
    out = quality_rules.quality(dealt(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_substring_dedup, op4_license_scan, op5_bpe_codec, op6_line_dedup, op7_quality_rules, op8_pii, op9_decontamination, op10_warc)}

ORACLES = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS k FROM s),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM g),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE first_id < doc_id),
        r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []::BIGINT[]), i)), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)""",
    "op4_license_scan": license_scan.oracle(),
    "op6_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
        c AS (SELECT k, max(doc_id) AS last_id FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.doc_id, i, line, coalesce(last_id <> k.doc_id, false) AS gone FROM k LEFT JOIN c USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op7_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
        l AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, count(*) AS n FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
        lines AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup, sum((n - 1) * chars)::BIGINT AS dup_chars FROM l GROUP BY doc_id),
        g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, unnest([5, 6, 7, 8, 9, 10]) x(k) WHERE len(w) >= k),
        h AS (SELECT doc_id, k, i, md5(array_to_string(w[i:i + k - 1], ' ')) AS gram FROM g),
        r AS (SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, gram) AS n, row_number() OVER (PARTITION BY doc_id, k, gram ORDER BY i) AS at_ FROM h),
        c AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS i FROM r WHERE at_ > 1),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        t AS (SELECT doc_id, sum(length(word)) AS total FROM p GROUP BY doc_id),
        grams AS (SELECT doc_id, k, sum(length(word)) AS chars FROM c JOIN p USING (doc_id, i) GROUP BY doc_id, k),
        share AS (SELECT doc_id, bool_or(chars > 100 AND chars / total > (CASE k WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 7 THEN 0.13 WHEN 8 THEN 0.12 WHEN 9 THEN 0.11 ELSE 0.10 END)::DOUBLE) AS bad
                  FROM grams JOIN t USING (doc_id) GROUP BY doc_id),
        rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r WHERE k = 8 AND n > 1) GROUP BY doc_id),
        b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup_chars, 0) AS dup_chars, coalesce(share.bad, false) AS bad_grams
              FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN share USING (doc_id) LEFT JOIN rep USING (doc_id)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND (dup_chars <= 100 OR dup_chars / word_chars <= 0.2) AND NOT bad_grams AS kept
        FROM f""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, payload, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex,
                     max(page_id) OVER (PARTITION BY payload) AS last_id FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + (CAST('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5) AS INT) >> (15 - 5 * (i % 4))::INT) % 32, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last_id THEN last_id END AS refers_to
        FROM d""",
}
