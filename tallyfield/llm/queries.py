"""The operators as named queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import documents
from tallyfield.llm.embedding_dedup import LINKS_SQL, link_embeddings
from tallyfield.llm.hard_negatives import NEGATIVES_SQL, hard_negatives
from tallyfield.llm.language_id import identify
from tallyfield.llm.license_scan import scan_licenses
from tallyfield.llm.minhash_dedup import near_duplicates
from tallyfield.llm.packing import pack_documents
from tallyfield.llm.quality_rules import QUALITY_SQL, quality_report
from tallyfield.llm.sharding import shard_documents
from tallyfield.llm.token_rollups import ROLLUP_SQL, corpus_rollup
from tallyfield.llm.spelling_variants import NOISE, VARIANTS_SQL, spelling_variants
from tallyfield.llm.token_planes import binary_ids
from tallyfield.llm.url_filters import judge_urls, urls_sql
from tallyfield.llm.word_bpe import encoded
from tallyfield.sources.tables import table


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return link_embeddings(table(spark, folder, "embeddings"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(documents(spark, folder))


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), words=2)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(documents(spark, folder))


def op7_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_rollup(documents(spark, folder))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documents(spark, folder)).drop("spans")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(documents(spark, folder))


def op10_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(documents(spark, folder), with_ids=False)


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(documents(spark, folder), noise=NOISE)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(table(spark, folder, "embeddings"), anchor=F.col("id") % 50 == 0, relabelled=7)


def op13_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    return binary_ids(documents(spark, folder))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_rollups": op7_token_rollups,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_word_bpe": op10_word_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_planes": op13_token_planes,
}

ORACLES = {
    "op1_url_filters": urls_sql(),
    "op2_embedding_dedup": LINKS_SQL,
    "op7_token_rollups": ROLLUP_SQL,
    "op9_quality_rules": QUALITY_SQL,
    "op11_spelling_variants": VARIANTS_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
}
