"""The corpus pipeline: five operators in a row over ``documents``, each on all that the one before it kept.

The line and near-duplicate stages change or drop copies only; toxicity drops what its model rejects; mixing repeats or
drops documents to meet the sources' targets; the last stage encodes and decodes every document's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inodelake.llm import bag_minhash, bpe, line_dedup, mixing, toxicity
from inodelake.llm.spark_io import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled documents of this stage's input."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bag_minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.apply(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: The model, the verified join and the tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
