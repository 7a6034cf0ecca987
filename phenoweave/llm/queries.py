"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, jaccard, langid, licenses, mixing, quality, rules, sharding, warc

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.coalesce(_fold(5) != 0, F.lit(False)))
    return out.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, F.coalesce(_fold(4) != 2, F.lit(False)))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.annotate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_paragraphs", F.array_join("families", ",").alias("families"), "n_notices", "score", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


def op7_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_source_mix, op3_quality_discriminant, op4_language_id, op5_jaccard_join,
        op6_license_scan, op7_distribution_rules, op8_warc, op9_feistel_shards, op10_exact_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT html, max(page_id) AS keep FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
        SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN k.keep IS NOT NULL AND p.page_id IS DISTINCT FROM k.keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id IS DISTINCT FROM k.keep THEN k.keep END AS refers_to
        FROM p LEFT JOIN k ON p.html = k.html""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT *, row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size
              FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
}
