"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bag_minhash, bpe, fingerprint, html_extract, line_dedup, media, mixing, quality_classifier, quality_rules, token_alignment, toxicity, url_filter, whitening
from .spark_io import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.apply(docs, toxicity.fit(docs, labels))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.apply(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.apply(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.apply(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.apply(docs, quality_classifier.fit(docs, labels))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.apply(pages, html_extract.fit(pages))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.apply(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.apply(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.apply(pages, url_filter.listed_hosts(pages))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.apply(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.apply(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.apply(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_rules, op2_toxicity, op3_source_mixing, op4_media_columns, op5_byte_bpe,
        op6_quality_classifier, op7_html_extraction, op8_line_dedup, op9_minhash_near_dedup, op10_url_filters,
        op11_document_fingerprints, op12_token_alignment, op13_embedding_whitening,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.oracle_sql(), "op3_source_mixing": mixing.ORACLE_SQL, "op10_url_filters": url_filter.oracle_sql(),
        "op11_document_fingerprints": fingerprint.oracle_sql(),
    }
