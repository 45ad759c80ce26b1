"""The queries of the ten corpus operators and of the pipeline, with SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, lines, packing, pii, quality, rollups, simhash, suffixes, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.maintained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_pii, op3_decontamination, op4_chat_rotation, op5_warc, op6_suffix_dedup, op7_simhash, op8_packing, op9_token_counts, op10_line_dedup)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS t FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
h AS (SELECT DISTINCT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS u(p) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

OP4_SQL = """
WITH m AS (SELECT conv_id, turn, replace(coalesce(role, ''), '<|im_', '<| im_') AS r, replace(coalesce(text, ''), '<|im_', '<| im_') AS t FROM conversations),
k AS (SELECT conv_id, r, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) - 1 AS k FROM m),
s AS (SELECT DISTINCT conv_id, r AS speaker FROM m),
x AS (SELECT k.conv_id, speaker, k // 64 AS part, k, r = speaker AS own, CASE WHEN r = speaker THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || r END || chr(10) AS head, t FROM k JOIN s ON k.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (SELECT *, coalesce(sum(length(head) + length(t) + 11) OVER (PARTITION BY conv_id, speaker, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM x)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, count(*) AS n_turns, count(*) FILTER (own) AS n_target, string_agg(head || t || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
coalesce(string_agg(CAST(a AS BIGINT) || ':' || CAST(a + length(t) + 10 AS BIGINT), ',' ORDER BY k) FILTER (own), '') AS mask_spans
FROM y GROUP BY conv_id, speaker, part
"""

#: Base32 of the digest's hexadecimal digits: ten of them, 40 bits, are eight characters of five bits.
OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
g AS (SELECT *, [CAST('0x' || substr(h, 10 * i + 1, 10) AS BIGINT) FOR i IN range(4)] AS v FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[j // 8 + 1] >> (35 - 5 * (j % 8))) & 31 AS BIGINT) + 1, 1) FOR j IN range(32)], '') AS payload_digest,
CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM g
"""

OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT r, doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS u(i)),
least_ AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s HAVING count(*) > 1),
cut AS (SELECT r, i FROM g JOIN least_ USING (s) WHERE doc_id > low),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS n FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM cut)),
spans AS (SELECT r, n, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY r, n),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM spans),
kept AS (SELECT r, sum(b - a) AS removed, count(*) AS n, string_agg(substring(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS k FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
gone AS (SELECT k FROM (SELECT DISTINCT k, doc_id FROM l WHERE length(k) >= 1) GROUP BY k HAVING count(*) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(gone.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.k = gone.k GROUP BY r
"""

def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op4_chat_rotation": OP4_SQL, "op5_warc": OP5_SQL, "op6_suffix_dedup": OP6_SQL, "op10_line_dedup": OP10_SQL}
