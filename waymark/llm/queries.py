"""The queries of this subpackage over the tables in a folder, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import exact_dedup, license_scan, line_dedup, mixing, packing, pii, quality, simhash, substring_dedup, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS uid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal FROM base GROUP BY source
), weighed AS (
  SELECT *, ordinal % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM sources
), levelled AS (
  SELECT *, cap / weight AS own,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
         / (sum(weight) OVER (ORDER BY cap / weight, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS if_uncapped
  FROM weighed
), water AS (
  SELECT coalesce((SELECT if_uncapped FROM levelled WHERE if_uncapped <= own ORDER BY own, ordinal LIMIT 1), (SELECT max(own) FROM levelled)) AS level
), targets AS (
  SELECT source, source_size, ordinal, weight, total, CASE WHEN own <= level THEN cap::DOUBLE ELSE level * weight END AS target FROM levelled, water
), queued AS (
  SELECT b.*, source_size, ordinal, weight, total, target,
         (sum(size) OVER (PARTITION BY b.source ORDER BY place, doc_id, size, uid ROWS UNBOUNDED PRECEDING))::BIGINT AS sent
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, (r * source_size + sent) / weight AS finish FROM queued, (VALUES (0), (1), (2)) AS rounds(r)
), ranked AS (
  SELECT *, sum(size) OVER (ORDER BY finish, ordinal, place, doc_id, size, uid ROWS UNBOUNDED PRECEDING) AS upto FROM copies
)
SELECT doc_id, size, source_size, target, (size * sum((upto <= total)::BIGINT))::BIGINT AS taken
FROM ranked GROUP BY uid, doc_id, size, source_size, target
"""

def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_lines(documents(spark, sf_dir))


OP5_SQL = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT uid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), held AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT uid) >= 5
), marked AS (
  SELECT k.*, h.key IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed k LEFT JOIN held h USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY uid, doc_id
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_mixing": OP3_SQL, "op5_line_dedup": OP5_SQL}
