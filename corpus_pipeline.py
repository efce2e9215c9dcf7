"""A document pipeline of five stages; each writes its rows as Parquet and the next one reads them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm.common import stored
from echolens.llm.exact_dedup import drop_exact_copies
from echolens.llm.mixing import apply_mix
from echolens.llm.packing import pack_documents
from echolens.llm.quality import clean_lines
from echolens.llm.simhash import drop_near_copies

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much text.

    Null and empty texts have no words and go; rows that repeat are judged alike; an empty table stays empty.
    """
    return clean_lines(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null counts as empty, so one such row stays; of rows that repeat one stays; an empty table stays empty.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of three-word shingles that differ in at most three bits, the smallest id stays.

    Texts without words share fingerprint zero; a null id stays only where all are null; of rows with that id the first
    one stays. An empty table stays empty.
    """
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until the sources' words meet their targets.

    A null source is a source of its own; texts without words are not taken; rows that repeat are documents of their own;
    an empty table stays empty.
    """
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1,024 ids; repeated documents are packed each time.

    Null and empty texts are one id, the end of the document; an empty table has no pieces.
    """
    return pack_documents(docs, TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("packing", packing),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests run the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
