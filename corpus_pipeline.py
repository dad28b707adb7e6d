"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from axiloom.llm import exact_dedup, mixing, packing, quality, simhash
from axiloom.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or the learned decision list reject. Null and empty texts have no words and
    go; rows that repeat a doc_id, or have none, are judged each by its own text; no row stays of an empty table."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keep the one with the largest doc_id, of several rows with it one; a null doc_id
    is less than any. Null texts equal empty ones."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, keep the document with the least doc_id, of several rows with it one; a null
    doc_id only where no other has one. Texts without words are copies of each other."""
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out and repeat documents so that each source comes near its target, in the order of the schedule. Texts
    without words are left out; a null source is one of its own; rows that share a doc_id are taken one by one."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences: one row per piece. Each row is packed, whatever its doc_id; no pieces come of
    an empty table."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The mix follows a hash order and packing a tokenizer; SQL has neither. tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
