"""Queries of the training-data operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkcorr.llm import decontaminate, fixity, html_text, packing, passages, pii, quality_rules, simhash, substrings, url_filter
from sparkcorr.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: (verdict, host/path); the longest that fits decides.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the pages' archives against a replica that has decayed."""
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.decayed(pages))


def op3_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.filter_urls(pages, url_filter.campaign_urls(pages), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(table(spark, sf_dir, "documents"))


def base_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules rest on, of every whole text."""
    counted = quality_rules.text_statistics(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def base_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of undisguised identifiers in every whole text."""
    return pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_fixity": op2_fixity,
        "op3_pii_deobfuscation": op3_pii_deobfuscation,
        "op4_suffix_array": op4_suffix_array,
        "op5_decontamination": op5_decontamination,
        "op6_html_text": op6_html_text,
        "op7_url_filter": op7_url_filter,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_compact_windows": op10_compact_windows,
        "base_text_statistics": base_text_statistics,
        "base_identifiers": base_identifiers,
    }


OP7_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parsed
), keyed AS (
  SELECT *,
         CASE WHEN host <> '' THEN
           regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
           CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END
         END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)'))) AS params FROM split)
), rules(rule, rule_verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
), ruled AS (
  SELECT k.*, (SELECT max_by(rule, length(rule)) FROM rules
     WHERE (k.host = split_part(rule, '/', 1) OR suffix(k.host, '.' || split_part(rule, '/', 1)))
       AND starts_with(k.path, substr(rule, instr(rule, '/')))) AS rule
  FROM keyed k
), listed AS (
  SELECT DISTINCT canonical FROM keyed WHERE canonical IS NOT NULL AND regexp_matches(url, '[?&]utm_[a-z]+=')
)
SELECT page_id, host, path, r.rule,
       coalesce(u.rule_verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       r.rule IS NULL AND l.canonical IS NOT NULL AS listed
FROM ruled r LEFT JOIN rules u ON u.rule = r.rule LEFT JOIN listed l ON l.canonical = r.canonical
"""


OP2_SQL = r"""
WITH replica AS (
  SELECT 'ours' AS side, page_id, url, html FROM pages
  UNION ALL
  SELECT 'theirs', page_id, url,
         CASE WHEN mark IN ('00', '01', '02', '03') THEN '?' || substr(html, 2) ELSE html END
  FROM (SELECT *, substr(md5(concat_ws('#', coalesce(url, ''), page_id::VARCHAR)), 1, 2) AS mark FROM pages)
  WHERE mark NOT IN ('fe', 'ff')
), bytes AS (
  SELECT side, page_id,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) ||
         'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) ||
         'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) ||
         'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) ||
         'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) ||
         coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM replica
), recs AS (
  SELECT side, page_id, CAST(floor(page_id / 4096) AS BIGINT) AS archive, CAST(page_id % 4096 AS BIGINT) AS slot,
         strlen(record) AS length, sha256('record:' || record) AS digest
  FROM bytes
), placed AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY side, archive ORDER BY slot, digest
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM recs
)
SELECT o.archive, o.page_id, o."offset", o.length, o.digest,
       CASE WHEN t.digest IS NULL THEN 'missing' WHEN t.digest = o.digest THEN 'intact' ELSE 'corrupt' END AS status
FROM placed o LEFT JOIN placed t ON t.side = 'theirs' AND t.archive = o.archive AND t.slot = o.slot
WHERE o.side = 'ours'
"""


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT rid, doc_id, i, substr(h, 2 * i - 1, 100) AS w
  FROM (SELECT *, unnest(range(1, length(h) // 2 - 48)) AS i FROM docs)
), firsts AS (
  SELECT w, min(doc_id) AS least FROM strings GROUP BY w HAVING min(doc_id) IS DISTINCT FROM max(coalesce(doc_id, 9223372036854775807))
), hits AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM strings JOIN firsts USING (w) WHERE least < coalesce(doc_id, 9223372036854775807)
), spans AS (
  SELECT rid, min(i) AS first, max(i) + 49 AS last
  FROM (SELECT *, count_if(before IS NULL OR i > before + 50) OVER (PARTITION BY rid ORDER BY i) AS span FROM hits) GROUP BY rid, span
), pieces AS (
  SELECT rid, first, last, lag(last, 1, 0) OVER (PARTITION BY rid ORDER BY first) AS since FROM spans
), cut AS (
  SELECT rid, sum(last - first + 1) AS n_removed, count(*) AS n_spans, max(last) AS until,
         string_agg(substr(h, 2 * since + 1, 2 * (first - 1 - since)), '' ORDER BY first) AS head
  FROM pieces JOIN docs USING (rid) GROUP BY rid
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN until IS NULL THEN h ELSE head || substr(h, 2 * until + 1) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)
"""


BASE_TEXT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS times
  FROM (SELECT rid, i, words[i:i + 4] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM counted))
), repeated AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM windows WHERE times > 1) GROUP BY rid
), told AS (
  SELECT rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed
FROM told LEFT JOIN repeated USING (rid)
"""


BASE_IDENTIFIERS_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), forms(k, kind, form) AS (
  VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
         (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')
), listed AS (
  SELECT * FROM (SELECT rid, k, kind, text, regexp_extract_all(text, form) AS found FROM docs, forms) WHERE len(found) > 0
), placed AS (
  -- a match starts where its string first occurs after the end of the match before
  SELECT rid, k, kind, found, 1 AS n, found[1] AS m, CAST(instr(text, found[1]) - 1 AS BIGINT) AS s, substr(text, instr(text, found[1]) + length(found[1])) AS rest FROM listed
  UNION ALL
  SELECT rid, k, kind, found, n + 1, found[n + 1], CAST(s + length(m) + instr(rest, found[n + 1]) - 1 AS BIGINT), substr(rest, instr(rest, found[n + 1]) + length(found[n + 1])) FROM placed WHERE n < len(found)
), digits AS (
  SELECT rid, k, kind, m, s, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM placed
), kept AS (
  SELECT * FROM digits WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || substr(ltrim(x, '0'), 1, 4) AS INTEGER) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(d)), lambda i:
      CASE WHEN i % 2 = 0 THEN CAST(substr(d, length(d) - i, 1) AS INTEGER)
      ELSE 2 * CAST(substr(d, length(d) - i, 1) AS INTEGER) - CASE WHEN substr(d, length(d) - i, 1) >= '5' THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    ELSE true END
), told AS (
  SELECT rid, count_if(k = 0) AS n_email, count_if(k = 1) AS n_ip, count_if(k = 2) AS n_card, count_if(k = 3) AS n_phone,
         string_agg(kind || ':' || s || ':' || s + length(m), ',' ORDER BY s, k) AS spans
  FROM kept GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card,
       CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM docs LEFT JOIN told USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_fixity": OP2_SQL, "op4_suffix_array": OP4_SQL, "op7_url_filter": OP7_SQL, "base_text_statistics": BASE_TEXT_SQL, "base_identifiers": BASE_IDENTIFIERS_SQL}
