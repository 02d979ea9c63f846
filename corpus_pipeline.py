"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import crc_mod, written
from tallyforge.llm.decontaminate import clean_documents
from tallyforge.llm.exact_dedup import drop_copies
from tallyforge.llm.ngram_join import one_of_each_group
from tallyforge.llm.packing import pack_documents
from tallyforge.llm.quality import fit_quality, good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go. The classifier learns from the labels of four fifths of the ids, as its query does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 5) != 0)
    return good_documents(docs, fit_quality(docs, labels), least=0.3)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest id."""
    return drop_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by a five-word Jaccard similarity of 0.8 or more stays: the one with the smallest id."""
    return one_of_each_group(docs, words=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark passages go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, added_tokens=True)


STAGES = [("quality", quality), ("exact dedup", exact_copies), ("near duplicates", near_copies), ("benchmark decontamination", decontaminate), ("packing", packing)]

#: SQL cannot express the classifier and the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
