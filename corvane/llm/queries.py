"""The queries of this subpackage, by contract, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files lie; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.packing import pack

    return pack(_docs(spark, sf_dir), vocabulary())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.mixing import mix_by_source

    return mix_by_source(_docs(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.sharding import shard

    return shard(_docs(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.fingerprints import fingerprint

    return fingerprint(_docs(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.simhash import near_components

    return near_components(_docs(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.pii import personal_data

    return personal_data(_docs(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.token_counts import count_tokens

    return count_tokens(_docs(spark, sf_dir), vocabulary())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.substring_dedup import repeated_passages

    return repeated_passages(_docs(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality import classify

    return classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def _crc_step(value: int, polynomial: int = 0xEDB88320) -> int:
    for _ in range(4):
        value = value >> 1 ^ (polynomial if value & 1 else 0)
    return value


# CRC-32 by half bytes, low half first
OP3_SQL = rf"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS src,
    substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 15) AS h
  FROM documents
), halves AS (
  SELECT doc_id, src, h, CAST(strlen(text) + 8 AS BIGINT) AS size, list_transform(regexp_extract_all(regexp_replace(hex(text), '(.)(.)', '\2\1', 'g'), '.'), lambda x: CAST('0x' || x AS BIGINT)) AS l FROM rows
), summed AS (
  SELECT doc_id, src, h, size, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda c, x: xor(c >> 4, {[_crc_step(i) for i in range(16)]}[xor(c & 15, x) + 1])), 4294967295) AS text_crc32 FROM halves
), ranked AS (
  SELECT *, CAST(2 * (row_number() OVER (PARTITION BY src ORDER BY h) - 1) + 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY src) AS DOUBLE) AS share FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY share, src, h) - 1 AS place, count(*) OVER () AS total FROM ranked
), cut AS (SELECT *, CAST(place * 24 // total AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, shard, CAST(place - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": OP3_SQL, "op5_exact_dedup": OP5_SQL}
