"""Registered queries on the smallest tables: against SQL where there is one, and one row per input row elsewhere."""

import pytest
from oracle import compare, connect

from tallyfield.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", ["op4_sharding", "op5_minhash_dedup", "op6_language_id", "op8_license_scan", "op10_word_bpe"])
def test_one_row_per_document(spark, name):
    want = sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    assert sorted(r[0] for r in QUERIES[name](spark, FOLDER).select("doc_id").collect()) == want


def test_entry_point_hands_out_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())
