"""One query for each operator: over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colfold.llm import best_fit_packing, media_columns, quality_classifier, quality_rules, sentence_pieces, sharding, simhash_near_dedup, suffix_dedup, token_counts, warc_segments
from colfold.llm.common import stored, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.digests(stored(media_columns.to_media(table(spark, sf_dir, "documents")), "media"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"), words=suffix_dedup.WORDS)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_segments.round_trip(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_media_columns, op3_token_counts, op4_quality_rules, op5_sharding, op6_sentence_pieces, op7_suffix_array_dedup, op8_simhash_near_dedup, op9_warc, op10_quality_classifier)}


#: The archive's contract on the plain table: SHA-1 in base 32 five hex digits (four letters) at a time, the smallest page of a digest.
WARC_SQL = """
WITH sized AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digested AS (
    SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY hex) AS original,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - i % 4 * 5)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest
    FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM digested"""


#: The others return tokens, hashes of a kind that DuckDB lacks, stored forms, fitted models or a packing, so they have none.
def oracle_sql() -> dict[str, str]:
    return {"op9_warc": WARC_SQL}
