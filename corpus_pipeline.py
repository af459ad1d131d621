"""From raw documents to packed sequences: five stages, each a table in the shared folder that the next one reads.

Counts as part of wardenry.llm. Every stage works on all rows that its predecessor kept, and all but the last return the columns of documents; further columns stay with them, whatever their names.
Texts may be of any length, rows that repeat are handled each (and become one among near-duplicates), an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardenry.llm import decontaminate, language_id, near_dedup, packing, secrets
from wardenry.llm.common import scratch, spread, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those without a language: null or empty text, no letters, or less than even odds for the best. Without a labelled document nothing can be told, and all go."""
    return language_id.keep_identified(docs, language_id.train(docs.where(~language_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 0.8 of its 5-word shingles: that of the smallest doc_id, and of several rows with it the one of the least text. Documents without words, or without doc_id, stay."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty, or more, lies in benchmark passages. Without words none does; an empty benchmark drops none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; n_chars stays what the source said. Null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is its end id alone."""
    return packing.pack_documents(docs).drop("copy")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secret_scan", secret_scan), ("pack", pack)]

#: SQL has no trained models, tokenizer or packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
