"""Corpus pipeline: quality filter, near-duplicates, repeated passages, packing.

Each stage reads what its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import packing, quality, simhash, suffix
from creditloom.llm.common import discard, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels`` and the documents at hand."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose fingerprints (three-word shingles) two bits or fewer link.

    Rows that share both id and text are one document: one of them stays. Rows without an id, which are in no group, stay.
    """
    found = simhash.near_duplicates(docs, "pipeline-simhash").where("doc_id = component_id")
    kept = found.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n"))
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(kept, F.col("row.doc_id") == F.col("kept_id"))
    single = rows.where("n = 1").select("row.*")
    several = rows.where("n > 1").select("row.*").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several).unionByName(docs.where("doc_id is null"))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller id, or they themselves further
    up, hold too."""
    return suffix.deduplicated(docs, purpose="pipeline-suffix", within=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), purpose="pipeline-packing")


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("best-fit packing", pack),
]

#: SQL can express neither the trained network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written as Parquet and read again, and removed once the next
    stage's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
