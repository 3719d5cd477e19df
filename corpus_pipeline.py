"""The corpus pipeline: each stage calls one operator of ``molinete.llm`` and works on all that the stage before kept."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from molinete.llm.exact_dedup import drop_exact_copies
from molinete.llm.mixing import mixed_documents
from molinete.llm.packing import pack_documents
from molinete.llm.simhash import drop_near_copies
from molinete.llm.toxicity import drop_toxic, fit_toxicity
from molinete.session import work_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of this stage's documents."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return drop_toxic(docs, fit_toxicity(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of three-word shingles within two bits stays."""
    return drop_near_copies(docs, words_per_shingle=3, max_bits=2)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens; a repeated document is packed each time."""
    return pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Hashes and models have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return STAGES[-1][1](spark, docs, sf_dir)
