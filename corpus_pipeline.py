"""A corpus pipeline: quality rules, language, near duplicates, packing. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import documents
from tallyfield.llm.language_id import accepted
from tallyfield.llm.minhash_dedup import deduplicated
from tallyfield.llm.packing import pack_documents
from tallyfield.llm.quality_rules import clean_documents
from tallyfield.session import materialised


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail."""
    return clean_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network tells; it learns from what the first stage kept."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return deduplicated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("language", language), ("near duplicates", near_duplicates), ("packing", packing)]

# SQL cannot express the language and near-duplicate stages; the tests hold all stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
