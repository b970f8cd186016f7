"""Queries of the thirteen operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import attention_lm, fill_in_middle, language_id, line_dedup, mixing, outliers, packing, prefix_trie, quality_knn, scaled_sketch, secrets, simhash, substring_dedup
from gleanery.llm.common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(documents(spark, sf_dir)).drop("uid")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed", "longest_run")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(documents(spark, sf_dir), texts=False).drop("output", "restored")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_packing, op3_quality, op4_secret_scan, op5_quality_rules, op6_line_dedup, op7_lm_scores, op8_fingerprints, op9_mixing, op10_simhash, op11_fill_in_middle, op12_language_id, op13_prefix_trie)}


#: Equal lines at two places are pairs; successive pairs at one distance are a common run, and the longest one that begins at a place and earlier too is its run.
LINE_DEDUP_SQL = r"""
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), lines AS (
  SELECT doc_id, pos, md5(line) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq
  FROM parts WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), pairs AS (
  SELECT b.doc_id, b.seq, a.doc_id AS of, a.seq - b.seq AS shift FROM lines a JOIN lines b ON a.h = b.h AND (a.doc_id, a.seq) < (b.doc_id, b.seq)
), islands AS (
  SELECT *, seq - row_number() OVER (PARTITION BY doc_id, of, shift ORDER BY seq) AS island FROM pairs
), runs AS (
  SELECT doc_id, seq, max(length) AS length FROM (SELECT doc_id, seq, count(*) OVER (PARTITION BY doc_id, of, shift, island ORDER BY seq DESC) AS length FROM islands) GROUP BY doc_id, seq
), gone AS (
  SELECT doc_id, unnest(range(seq, seq + length)) AS seq FROM runs WHERE length >= 2
  UNION SELECT doc_id, seq FROM runs JOIN lines USING (doc_id, seq) WHERE words >= 20
), counted AS (
  SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
), rest AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text FROM parts p LEFT JOIN lines l USING (doc_id, pos)
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.seq = l.seq WHERE g.seq IS NULL GROUP BY p.doc_id
), longest AS (
  SELECT doc_id, max(length) AS n FROM runs WHERE length >= 2 GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN r.n_removed IS NULL THEN d.text WHEN r.n_removed = c.n_lines THEN '' ELSE rest.text END AS text,
       coalesce(c.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, CAST(coalesce(x.n, 0) AS BIGINT) AS longest_run
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN removed r USING (doc_id) LEFT JOIN rest USING (doc_id) LEFT JOIN longest x USING (doc_id)
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('7:' || doc_id) AS draw FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM sized GROUP BY source
), ratios AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS k FROM sources
), levels AS (
  SELECT *, CAST(1.5 * (SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ratios
), level AS (
  SELECT arg_min(level, k) AS level FROM levels WHERE level * weight < cap
), plan AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM level) * weight) AS target FROM ratios
), run AS (
  SELECT s.*, p.source_size, p.target, CAST(floor(p.target / p.source_size) AS BIGINT) AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN whole < 2 AND cum - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM run
"""


#: Written apart from the operator's own SQL: cuts are places in the text, found by the lengths of units, and restored texts are joined from the cut text.
FILL_IN_MIDDLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(text, '') AS t, [length(x) FOR x IN regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')] AS sizes, sha256(concat('42:', doc_id)) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, sizes, CAST(len(sizes) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(sizes) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(sizes) + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS share, CAST('0x' || h[25:32] AS BIGINT) % 100 AS turned FROM sized
), cut AS (
  SELECT doc_id, t, n, CAST(coalesce(list_sum(sizes[1:least(a, b)]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(sizes[1:greatest(a, b)]), 0) AS BIGINT) AS q,
         CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR share >= 50 THEN 'plain' WHEN turned < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
                   ELSE '<S>' || substr(t, q + 1) || '<P>' || left(t, p) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256,
       sha256(left(t, p) || substr(t, p + 1, q - p) || substr(t, q + 1)) AS restored_sha256
FROM cut
"""


#: A node is a list of turns; each node counts at all its prefixes.
PREFIX_TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), bits(v) AS (SELECT unnest(range(256))
), crc_table AS (
  WITH RECURSIVE r(v, k, c) AS (SELECT v, 0, CAST(v AS BIGINT) FROM bits UNION ALL SELECT v, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM r WHERE k < 8)
  SELECT list(c ORDER BY v) AS t FROM r WHERE k = 8
), crc AS (
  WITH RECURSIVE r(conv_id, digits, k, c) AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT conv_id FROM turns)
    UNION ALL SELECT conv_id, digits, k + 1, xor(c // 256, (SELECT t FROM crc_table)[xor(c % 256, ascii(digits[k])) + 1]) FROM r WHERE k <= length(digits)
  ) SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM r WHERE k = length(digits) + 1
), rebuilt AS (
  SELECT conv_id, list(said ORDER BY part, pos) FILTER (WHERE said IS NOT NULL) AS said FROM (
    SELECT conv_id, 1 AS part, pos, said FROM turns JOIN crc USING (conv_id) WHERE pos > h
    UNION ALL SELECT c.conv_id, 0, b.pos, b.said FROM crc c JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos <= c.h
    UNION ALL SELECT conv_id, 2, 0, NULL FROM crc
  ) GROUP BY conv_id
), whole AS (SELECT conv_id, coalesce(said, []) AS said FROM rebuilt
), places AS (SELECT conv_id, unnest(range(len(said) + 1)) AS depth, said FROM whole
), nodes AS (
  SELECT said[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(said) = depth) AS ids FROM places GROUP BY ALL
), children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes n LEFT JOIN children USING (path, depth)
), totals AS (
  SELECT path[1:d] AS path, d AS depth, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY ALL
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n AS n_convs, CAST(c.n_children AS BIGINT) AS n_children, t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(c.ids, '')) AS ends_sha256
FROM counted c JOIN totals t USING (path, depth) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINE_DEDUP_SQL, "op9_mixing": MIXING_SQL, "op11_fill_in_middle": FILL_IN_MIDDLE_SQL, "op13_prefix_trie": PREFIX_TRIE_SQL}
