"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept,
and is written as Parquet before the next one reads it. Null and empty texts have no
words: they keep their rows but for what the classifier says, and packing makes them
one piece. Rows with a null id are never taken out as duplicates or as contaminated; other
rows repeated whole end as one if they have a word. Very long texts are taken whole.
Further columns are carried on until packing.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, minhash, packing, pii, quality
from tidemark.llm.common import read_table, shared_folder
from tidemark.llm.queries import VOCABULARY


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to give it away."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts the new text."""
    return pii.with_length(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("personal_data", private), ("packing", packed)]

#: The classifier, the field and the packing aren't SQL; tests compare each stage with its operator, and operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
