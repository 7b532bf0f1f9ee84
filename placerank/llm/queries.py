"""The operators as named queries over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.llm import exact_dedup as exact
from placerank.llm import hard_negatives as hard
from placerank.llm.common import table
from placerank.llm.decontaminate import decontaminate
from placerank.llm.license_scan import license_scan
from placerank.llm.line_dedup import dedup_lines
from placerank.llm.mixing import mix_sources
from placerank.llm.near_dedup import near_duplicates
from placerank.llm.pii import find_pii
from placerank.llm.quality import classify
from placerank.llm.secret_scan import find_secrets
from placerank.llm.spelling import spelling_variants
from placerank.llm.substring_dedup import remove_repeats
from placerank.llm.warc import archive_pages


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("found", "key")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "contaminated", "n_items", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), "covered")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), max_bits=None).select(
        "doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row is given the next label, as its contract says."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard.hard_negatives(rows.withColumn("label", label))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_near_dedup, op3_warc, op4_quality, op5_license_scan, op6_substring_dedup,
                                   op7_decontaminate, op8_mixing, op9_exact_dedup, op10_line_dedup, op11_hard_negatives, op12_secret_scan, op13_spelling_variants)}
ORACLES = {"op9_exact_dedup": exact.ORACLE, "op11_hard_negatives": hard.ORACLE}
