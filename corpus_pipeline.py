"""The corpus pipeline: quality rules, quality classifier, near-dedup, packing.

Each stage is one of the operators of `pactline.llm`, works on all rows that the stage before kept, and reads them from
the Parquet table in which they were written. All but the last return the columns of `documents`. The near-dedup stage
links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, tested exactly: candidates come from
the fingerprints of operator 2, and from a prefix filter for what these miss.

Defined results: a null or empty text falls to the quality rules; of repeated rows one stays; rows of null id are kept
or dropped by their texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm import gam, packing, repetition, shingles
from pactline.llm.common import crc_part, stored
from pactline.llm.queries import quality_labels

#: Not expressible in SQL: a trained classifier, fingerprints of hashes and a tokenizer.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep (operator 9)."""
    return repetition.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores at 0.3 or more (operator 6), learned from the labelled ones among them."""
    return gam.keep_good(docs, quality_labels(spark, sf_dir), crc_part("id", 5) != 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 2, then exactly): five-word shingles, similarity 0.8 or more."""
    return shingles.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of near-equal windows of 4,096 tokens (operator 5)."""
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
