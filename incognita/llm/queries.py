"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from incognita.llm import ann, decontaminate, importance, lang_id, licenses, line_dedup, lm_score, packing, pii, prefix_trie, secrets, sharding, simhash
from incognita.sources.tables import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_lines(read_table(spark, sf_dir, "documents"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.languages(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(read_table(spark, sf_dir, "documents"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_pseudo_likelihood": op3_pseudo_likelihood,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_license_scan": op8_license_scan,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_sharding": op10_sharding,
    "op11_secret_scan": op11_secret_scan,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP1 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM items WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM wins),
grams AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, lens WHERE len(ws) >= m)),
hits AS (SELECT g.doc_id, g.m, g.i, w.item_id FROM grams g JOIN wins w ON g.m = w.m AND g.win = w.win),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(w.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words w USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

# CRC-32 of a string's UTF-8 bytes: the table of 256 entries follows from its polynomial, eight shifts for each byte value.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([CAST(b AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8],
                          lambda acc, x: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END) ORDER BY b) AS tab
  FROM range(256) t(b))"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of ``text``; needs the column ``tab`` of crc_table."""
    byte = f"(instr('0123456789ABCDEF', hex({text})[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', hex({text})[2 * i + 2]) - 1"
    codes = f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: CAST({byte} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda acc, b: xor(acc // 256, tab[xor(acc % 256, b) + 1])), 4294967295)"


_OP12 = rf"""
WITH {_CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
items AS (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
doc_words AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM docs) GROUP BY r, w),
item_words AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM items) GROUP BY w),
vocabulary AS (
  SELECT w, {_crc32("w")} % 10000 AS bucket
  FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words), crc_table),
source AS (SELECT bucket, sum(n) AS s FROM doc_words JOIN vocabulary USING (w) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM item_words JOIN vocabulary USING (w) GROUP BY bucket),
totals AS (SELECT CAST((SELECT sum(s) FROM source) AS DOUBLE) AS s_all, CAST(coalesce((SELECT sum(t) FROM target), 0) AS DOUBLE) AS t_all),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM source LEFT JOIN target USING (bucket), totals),
sums AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS g FROM doc_words JOIN vocabulary USING (w) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features,
         CASE WHEN len(ws) = 0 THEN 0 ELSE (g - ((g % len(ws)) + len(ws)) % len(ws)) // len(ws) END AS weight
  FROM docs LEFT JOIN sums USING (r)),
scored AS (
  SELECT r, doc_id, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((CAST(('0x' || left(sha256('2024:' || doc_id), 8)) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS k FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN k <= (SELECT count(*) * 10 // 100 FROM ranked) THEN CAST(k AS BIGINT) END AS rank, n_features AS n_words
FROM scored LEFT JOIN ranked USING (r)
"""

_OP13 = rf"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 20 AS base, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h, n
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc_table),
sized AS (SELECT a.c, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS m FROM convs a LEFT JOIN convs b ON b.c = a.base),
path AS (
  SELECT s.c, t.i AS d, t.role, t.text FROM sized s JOIN turns t ON t.c = s.base AND t.i <= s.m
  UNION ALL
  SELECT s.c, t.i - s.h + s.m, t.role, t.text FROM sized s JOIN turns t ON t.c = s.c AND t.i > s.h),
seqs AS (
  SELECT s.c, count(p.c) AS len, list(struct_pack(r := p.role, t := p.text) ORDER BY p.d) FILTER (p.c IS NOT NULL) AS said
  FROM sized s LEFT JOIN path p ON p.c = s.c GROUP BY s.c),
members AS (
  SELECT c, len, d, CASE WHEN d > 0 THEN md5(CAST(to_json(said[1:d]) AS VARCHAR)) ELSE '' END AS k,
         CASE WHEN d > 0 THEN said[d].t ELSE '' END AS t
  FROM (SELECT c, len, said, unnest(range(0, len + 1)) AS d FROM seqs)),
nodes AS (
  SELECT d, k, min(c) AS c, count(*) AS n_convs, count(*) FILTER (len = d) AS n_ends,
         (count(*) - 1) * max(len(regexp_extract_all(t, '[^ 	-
]+'))) AS saved,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = d), '') AS ends
  FROM members GROUP BY d, k),
totals AS (
  SELECT m.d, m.k, sum(CASE WHEN y.n_ends = y.n_convs THEN 1 ELSE 0 END) AS leaves, sum(y.saved) AS saved, count(*) FILTER (y.d = m.d + 1) AS kids
  FROM nodes y JOIN members m ON m.c = y.c AND m.d <= y.d GROUP BY m.d, m.k),
parents AS (SELECT n.d, n.k, p.c AS parent FROM nodes n JOIN members m ON m.c = n.c AND m.d = n.d - 1 JOIN nodes p ON p.d = m.d AND p.k = m.k)
SELECT CAST(n.c AS BIGINT) AS conv_id, CAST(n.d AS BIGINT) AS depth, CAST(p.parent AS BIGINT) AS parent_conv_id, n.n_convs,
       CAST(t.kids AS BIGINT) AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN totals t USING (d, k) LEFT JOIN parents p USING (d, k)
"""

ORACLES: dict[str, str] = {"op1_decontamination": _OP1, "op12_importance_resampling": _OP12, "op13_prefix_trie": _OP13}
